"""Language identification by Bayesian evidence fusion (operator 3).

Evidence for each page: the likelihood of its text under byte-trigram models of each language, the language its markup
declares, its address suffix (top-level domain and language path), and a prior of its host. All but the text
model come from grouped aggregation of the text posteriors over the whole table: counts of languages by declared
language, by suffix and by host, each smoothed towards the level above (host to domain, domain to suffix, suffix to
all), so that a host with few pages follows its domain; a page's own posterior is left out of them. The posterior is the
normalised product.

The text model counts 2**14 trigram classes of every labelled document, for every label. It is made and sent in blocks
of labels, so that the driver works on one block at a time; a worker reads all, 128 kB a label. A row's scores and
posteriors are arrays with one place a label.
Rejected are rows without letters, rows that no language fits, and rows whose posterior is below a limit. A language
fits if the mean log-likelihood of the row's trigrams isn't below that of equally likely classes, or, where the language's
own labelled documents (each scored without its own counts) do worse, below their usual range; less three standard
errors for the number of distinct trigrams, so texts too short or monotonous to tell aren't rejected by that. Rows that
no language fits are 'und' and don't count in any prior.

Edge cases: null and empty texts have no letters and are rejected as 'und'; null evidence is its own value; ties go to
the first language in alphabetical order; without labelled rows everything is 'und'; an empty table gives an
empty result; repeated rows count as often as they stand there; texts and markup of any length are read whole, in time
proportional to them; of df, only the named columns matter.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from .textops import LOWER, slices, small_batches, stored, tidy

CLASSES = 1 << 14
BLOCK = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_TAG = re.compile(r"<(script|style|nav|noscript|html)\b", re.I | re.A)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I | re.A) for x in ("script", "style", "nav", "noscript")}
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.I | re.A)
_ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)(?::\d+)?(?:/([a-z]{2})(?=[/?#]|$))?")


def trigrams(buf: np.ndarray, offs: np.ndarray):
    """(class, row) of byte trigrams of lower-cased letters; all else counts as a blank, runs of blanks as one."""
    buf = LOWER[buf]
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    x = np.where(_LETTER[buf], buf, 32).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (rows[1:] != rows[:-1])
    x, rows = x[keep], rows[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.bincount(rows[x != 32], minlength=len(offs) - 1)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    same = rows[:-2] == rows[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)[same], rows[:-2][same], np.bincount(rows[x != 32], minlength=len(offs) - 1)


def fit(labelled, text_col: str = "text", label_col: str = "lang"):
    """(languages, broadcast blocks of BLOCK languages, usual ranges) of labelled documents. A block has the smoothed
    counts of its languages, a table of fixed size for each."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(label_col).cast("string")).alias("lang"))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not names:
        return names, [], np.zeros((3, 0))
    number = {x: i for i, x in enumerate(names)}

    def emitted(held):
        for i, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * 8, pa.int32()), pa.array(range(8), pa.int32()), pa.array(list(np.split(table, 8)), pa.list_(pa.int64()))], ["lang", "part", "n"])

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at, buf, offs in slices(batch.column("text")):
                code, row, _ = trigrams(buf, offs)
                here, of = np.unique(lang[at : at + len(offs) - 1], return_inverse=True)
                cell, times = np.unique(of[row] * CLASSES + code, return_counts=True) if len(here) > BLOCK else _counted(of[row] * CLASSES + code, len(here))
                for j, i in enumerate(here.tolist()):
                    x, y = np.searchsorted(cell, [j * CLASSES, (j + 1) * CLASSES])
                    if i not in held:
                        held[i] = np.zeros(CLASSES, np.int64)
                    held[i][cell[x:y] - j * CLASSES] += times[x:y]
                    if len(held) > 2 * BLOCK:
                        yield from emitted(held)
                        held = {}
        yield from emitted(held)
        tidy()

    width = CLASSES // 8
    counts = rows.mapInArrow(count, "lang int, part int, n array<long>")
    summed = counts.select("lang", "part", F.posexplode("n")).groupBy("lang", "part", "pos").agg(F.sum("col").alias("n")).filter("n > 0")
    summed = summed if len(names) <= BLOCK else stored(summed, "classes")
    blocks = []
    for first in range(0, len(names), BLOCK):
        got = summed.filter(F.col("lang").between(first, first + BLOCK - 1)).toArrow()
        table = np.full((min(BLOCK, len(names) - first), CLASSES), 0.5)
        table[got.column("lang").to_numpy() - first, got.column("part").to_numpy() * width + got.column("pos").to_numpy()] += got.column("n").to_numpy()
        blocks.append(rows.sparkSession.sparkContext.broadcast(table))
    return names, blocks, _usual(rows, number, blocks)


def _counted(cells: np.ndarray, n: int):
    """The sorted distinct cells of n languages and how often each occurs."""
    times = np.bincount(cells, minlength=n * CLASSES)
    cell = np.flatnonzero(times)
    return cell, times[cell]


def _distinct(code: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """How many distinct classes each of m rows has."""
    seen = np.zeros(m * CLASSES, bool)
    seen[row * CLASSES + code] = True
    return np.count_nonzero(seen.reshape(m, CLASSES), axis=1)


def _usual(rows, number: dict, blocks: list) -> np.ndarray:
    """Three numbers of each language: median, spread below it, and variance in a document, of the log-likelihood a
    trigram of its own documents, each scored without its own counts."""

    def score(batches):
        counts = [b.value for b in blocks]
        sums = np.concatenate([x.sum(1) for x in counts])
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at, buf, offs in slices(batch.column("text")):
                code, row, _ = trigrams(buf, offs)
                m = len(offs) - 1
                key, times = np.unique(row * CLASSES + code, return_counts=True)
                row, code = key // CLASSES, key % CLASSES
                of, size = lang[at + row], np.bincount(row, times, m)
                had = np.empty(len(of))
                for b in np.unique(of // BLOCK).tolist():
                    part = of // BLOCK == b
                    had[part] = counts[b][of[part] % BLOCK, code[part]]
                x = np.log(had - times) - np.log(sums[of] - size[row])
                mean = np.bincount(row, times * x, m) / np.maximum(size, 1)
                within = np.bincount(row, times * (x - mean[row]) ** 2, m) / np.maximum(size, 1)
                keep = np.flatnonzero(size > 0)
                yield pa.RecordBatch.from_arrays([pa.array(lang[at + keep], pa.int32()), pa.array(mean[keep]), pa.array(within[keep])], ["lang", "mean", "within"])

    found = rows.mapInArrow(score, "lang int, mean double, within double").groupBy("lang").agg(F.percentile_approx("mean", [0.25, 0.5], 1000).alias("at"), F.percentile_approx("within", 0.5, 1000).alias("within"))
    usual = np.full((3, len(number)), np.array([[0.0], [np.inf], [0.0]]))
    for r in found.collect():
        usual[:, r.lang] = r.at[1], (r.at[1] - r.at[0]) / 0.6745, r.within
    return usual


def read_markup(page: str) -> tuple[str, str | None]:
    """(text, language of the html tag) of markup in one pass: comments and what script, style, nav and noscript hold
    are no text. What is never closed hides nothing but its tag."""
    pieces, declared, at, open_ended = [], None, 0, set()
    while (j := page.find("<", at)) >= 0:
        pieces.append(page[at:j])
        if page.startswith("<!--", j) and "<!--" not in open_ended:
            end = page.find("-->", j + 4)
            if end >= 0:
                at = end + 3
                continue
            open_ended.add("<!--")
        end = page.find(">", j)
        if end < 0:
            at = j
            break
        at = end + 1
        if m := _TAG.match(page, j):
            name = m[1].lower()
            if name == "html":
                if declared is None and (said := _LANG.search(page, m.end(), at)):
                    declared = said[1]
            elif name not in open_ended:
                if shut := _CLOSED[name].search(page, at):
                    at = shut.end()
                else:
                    open_ended.add(name)
    pieces.append(page[at:])
    return entities.unescape(" ".join(pieces)), declared


def identify(df, model, id_col: str, text_col: str, declared_col: str | None = None, url_col: str | None = None, host_col: str | None = None, is_html: bool = False, least: float = 0.2, temper: float = 0.25, strength: float = 20.0, far: float = 6.0):
    """One row per row of df: id_col, lang, probability, text_lang, declared, suffix, host, n_letters, rejected.

    is_html: text_col holds markup, whose text and declared language are taken. temper: power of the text
    likelihood, whose trigrams overlap. strength: rows that a level of the host prior weighs as much as. least: limit
    of the posterior, which is also that part above chance (1/languages) at least. far: spreads below the
    median that are the usual range of a language's own documents.
    """
    small_batches(df.sparkSession)
    names, blocks, usual = model
    n = len(names)
    column = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
    rows = df.select(F.col(id_col).alias("id"), column(text_col).alias("text"), column(declared_col).alias("declared"), column(url_col).alias("url"), column(host_col).alias("host"))
    kind = df.schema[id_col].dataType.simpleString()

    def read(batches):
        tables = [np.log(x / x.sum(1, keepdims=True)) for x in (b.value for b in blocks)]
        median, spread, within = usual
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                declared, text, hosts, suffixes = part.column("declared").to_pylist(), part.column("text"), part.column("host").to_pylist(), []
                if is_html:
                    read = [read_markup(x or "") for x in text.to_pylist()]
                    declared = [d or own for d, (_, own) in zip(declared, read, strict=True)]
                    text = pa.array([t.encode("utf-8", "replace").decode() for t, _ in read], pa.string())
                for i, url in enumerate(part.column("url").to_pylist()):
                    m = _ADDRESS.match(url or "")
                    hosts[i] = hosts[i] or (m[1].lower() if m else None)
                    suffixes.append(f"{hosts[i].rpartition('.')[2]}/{(m[2] or '').lower()}" if m else None)
                domains = [".".join(h.split(".")[-2:]) if h else None for h in hosts]
                scores, letters, fits = np.zeros((part.num_rows, n)), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
                for lo, buf, offs in slices(text):
                    code, row, had = trigrams(buf, offs)
                    m = len(offs) - 1
                    letters[lo : lo + m] = had
                    for k in range(n):
                        scores[lo : lo + m, k] = np.bincount(row, tables[k // BLOCK][k % BLOCK][code], m)
                    # trigrams overlap by three, and repeated ones tell nothing new
                    all_, own = np.bincount(row, minlength=m)[:, None], np.maximum(_distinct(code, row, m), 1)[:, None]
                    least_mean = np.minimum(-np.log(CLASSES), median - far * spread) - 3 * np.sqrt(3 * within / own)
                    fits[lo : lo + m] = (scores[lo : lo + m] >= all_ * least_mean).any(1)
                logit = temper * scores
                logit -= logit.max(1, keepdims=True) if n else 0
                q = np.exp(logit)
                q = q / q.sum(1, keepdims=True) if n else q
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([x.lower() if x else None for x in declared], pa.string()), pa.array(suffixes, pa.string()), pa.array(domains, pa.string()), pa.array(hosts, pa.string()),
                    pa.array(letters), pa.array(fits), pa.array(list(logit), pa.list_(pa.float64())), pa.array(list(q), pa.list_(pa.float64())),
                ], ["id", "declared", "suffix", "domain", "host", "n_letters", "fits", "logit", "q"])
        tidy()

    read_rows = stored(rows.mapInArrow(read, f"id {kind}, declared string, suffix string, domain string, host string, n_letters long, fits boolean, logit array<double>, q array<double>"), "evidence")
    out = [F.col("id").alias(id_col)]
    if not n:
        return read_rows.select(*out, F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"), "declared", "suffix", "host", "n_letters", F.lit(True).alias("rejected"))
    known = F.when((F.col("n_letters") > 0) & F.col("fits"), F.col("q"))
    keys = ("declared", "suffix", "domain", "host")
    spread = read_rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in keys], F.coalesce(known, F.array_repeat(F.lit(0.0), n)).alias("q"))
    sums = lambda table, *by: table.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("q"))).alias("q"))
    counts = stored(sums(spread, *keys), "counts")
    total = sums(counts).first()
    whole = F.lit(((np.array(total.q) if total.q else np.zeros(n)) + 1.0).tolist())
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    level = lambda name, *by: sums(counts, *by).select(*by, F.col("q").alias(f"of_{name}"), added("q").alias(f"n_{name}"))
    host = level("host", "suffix", "domain", "host").join(level("domain", "suffix", "domain"), ["suffix", "domain"]).join(level("suffix", "suffix"), "suffix")
    host = stored(host.select(*[F.col(c).alias(f"k_{c}") for c in keys[1:]], *[f"{x}_{c}" for c in keys[1:] for x in ("of", "n")]), "hosts")
    declared = stored(sums(counts, "declared").select(F.col("declared").alias("k_declared"), F.col("q").alias("of_declared")), "declared")

    keyed = read_rows.select("*", *[F.coalesce(c, F.lit("")).alias(f"k_{c}") for c in keys], F.coalesce(known, F.array_repeat(F.lit(0.0), n)).alias("own"), F.when(known.isNotNull(), 1.0).otherwise(0.0).alias("one"))
    both = keyed.join(declared, "k_declared", "left").join(host, [f"k_{c}" for c in keys[1:]], "left")
    # what a row says itself is left out of what its neighbours say
    others = lambda sums: F.zip_with(sums, "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    every = F.zip_with(whole, "own", lambda x, y: F.greatest(x - y, F.lit(1e-9)))
    size = (float(sum(total.q)) if total.q else 0.0) + n
    p = F.transform(every, lambda x: x / (F.lit(size) - F.col("one")))
    for c in keys[1:]:
        scale = F.greatest(F.col(f"n_{c}") - F.col("one"), F.lit(0.0)) + F.lit(strength)
        p = F.transform(F.zip_with(others(f"of_{c}"), p, lambda x, up: x + F.lit(strength) * up), lambda x: x / scale)  # noqa: B023
    # P(declared | language) up to a factor that doesn't depend on the language
    says = F.when(F.col("k_declared") == "", F.array_repeat(F.lit(0.0), n)).otherwise(F.zip_with(others("of_declared"), every, lambda x, w: F.log((x + 1.0) / w)))
    score = F.zip_with(F.zip_with("logit", says, lambda a, b: a + b), p, lambda a, b: a + F.log(b))
    both = both.withColumn("score", score).withColumn("top", F.array_max("score"))
    both = both.withColumn("probability", F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    codes = F.lit(names)
    pick = lambda a, m: F.get(codes, (F.array_position(a, m) - 1).cast("int"))
    named = (F.col("n_letters") > 0) & F.col("fits")
    limit = max(least, (1 + least * (1 - 1 / n)) / n)
    both = both.withColumn("lang", F.when(named, pick(F.col("score"), F.col("top"))).otherwise("und")).withColumn("text_lang", F.when(named, pick(F.col("q"), F.array_max("q"))).otherwise("und"))
    p = F.when(named, F.col("probability")).otherwise(0.0)
    return both.select(*out, "lang", p.alias("probability"), "text_lang", "declared", "suffix", "host", "n_letters", (~named | (p < limit)).alias("rejected"))
