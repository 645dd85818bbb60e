"""The ten operators against brute force, on small tables with nulls, ties, repeats and very long texts."""

import base64
import hashlib
import json
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import fingerprints, jaccard, language, licences, mixing, packing, queries, repeats, scoring, textops, toolcalls, vectors

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string, id string, name string"


@pytest.fixture(scope="module")
def docs(spark):
    """Whole documents, and odd rows: nulls, empty, blank, very long, exact and near copies."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "k", "i", "n") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 120").collect()]
    base = rows[5][1]
    odd = [None, "", " \n\t", "one", "One two", "one TWO", "a b c", base, base, base + " more words", "x " * 20000, "é\x00\x1cñ  q\n" * 3, "All Rights  Reserved. CC-BY cc by"]
    rows += [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def root(parents, x):
    while parents[x] != x:
        x = parents[x]
    return x


def merge(parents, a, b):
    a, b = root(parents, a), root(parents, b)
    parents[max(a, b)] = min(a, b)


def shingles(text, n):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def shuffle_files(spark):
    return {f for d, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(textops.CLEANUP)
    table = textops.stored(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.max("id").alias("top")), "summed")
    assert table.count() == 50_000 and spark.conf.get(textops.CLEANUP) == setting
    for _ in range(50):  # they go in the background; the count's own are a few bytes
        left = shuffle_files(spark) - before
        if len(left) <= 1:
            break
        time.sleep(0.2)
    assert len(left) <= 1


def test_jaccard_keeps_few_tables(docs, spark):
    """Tables of prefixes and sets go when they are read for the last time."""
    at = len(textops.STORED)
    kept = {}
    jaccard.jaccard_components(docs).collect()
    for path in textops.STORED[at:]:
        name = path.rpartition("/")[2].rpartition("-")[0]
        place = Path(path.removeprefix("file://"))
        kept[name] = kept.get(name, False) or place.exists() and any(place.iterdir())
    assert not any(kept[x] for x in ("prefix", "marked", "sets")) and kept["sketch"]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(docs, texts, n, num, den):
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs, n, num, den).collect()}
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parents = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                merge(parents, a, b)
    assert len(got) == len(sets)
    assert all((got[d].n_shingles, got[d].component_id) == (len(s), root(parents, d)) for d, s in sets.items())


def test_jaccard_of_a_hot_group(spark, monkeypatch):
    """Near copies that mostly don't link with each other's first document, in many small blocks."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for d in range(60):
        w = base.copy()
        for at in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[at + 60 * (d % 2)] = f"{'ab'[d % 3 > 0]}{at}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: shingles(t, 5) for d, t in rows}
    parents = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                merge(parents, a, b)
    assert got == {d: root(parents, d) for d in sets} and len(set(got.values())) > 1


def rows_made(spark, since):
    """The most rows that a join, an explode or a Python function has made in the executions since that number, and the number of the last one."""
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList().iterator()
    while runs.hasNext():
        run = runs.next().executionId()
        last = max(last, run)
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes().iterator()
        while run > since and nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while re.search("Join|Generate|Arrow", node.name()) and metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last


def test_work_on_a_hot_group_does_not_grow_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 10)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 20)
    rng, base, made = np.random.default_rng(8), [f"w{i}" for i in range(300)], []
    for size in (100, 500):
        rows = []
        for d in range(size):
            w = base.copy()
            for at in rng.choice(300, int(rng.integers(0, 7)), replace=False):
                w[at] = f"{d}-{at}"
            rows.append((d, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        _, last = rows_made(spark, -1)
        jaccard.jaccard_components(docs).collect()
        made.append(rows_made(spark, last)[0])
    assert made[0] > 0 and made[1] < 8 * made[0]


def test_multi_match_prefixes_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.r_[a[: max(1, int(len(a) * rng.uniform(0.8, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)])
        counts = rng.integers(0, 5, 1 << jaccard.CLASS_BITS)
        if 10 * len(np.intersect1d(a, b)) < 8 * len(np.union1d(a, b)):
            continue
        (x, ex), (y, ey) = jaccard.prefix(a, counts, 8, 10), jaccard.prefix(b, counts, 8, 10)
        ell, need = min(ex, ey), -(-(len(a) + len(b)) * 8 // 18)
        assert len(np.intersect1d(x[: len(a) - need + ell], y[: len(b) - need + ell])) >= ell
        assert len(np.intersect1d(x[: len(a) - need + 1], y[: len(b) - need + 1])) >= 1
        differ = np.bitwise_count((jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b)) <= len(a) + len(b) - 2 * need


@pytest.mark.parametrize("size", [5, 50])
def test_repeats(docs, texts, size):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, size, carry=("shard",)).collect()}
    words, first = {d: t.encode().split() for d, t in texts.items()}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = True
        assert (got[d].kept, got[d].n_words, got[d].n_removed) == (b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), gone.sum())


def test_base_score(docs, texts):
    got = {r.doc_id: r for r in scoring.score(docs).collect()}
    apart = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter()
    for d, t in texts.items():
        if not apart[d]:
            counts.update([*t.encode().lower().split(), None])
    scale = sum(counts.values()) + 0.1 * (len(counts) + 1)
    for d, t in texts.items():
        w = [*t.encode().lower().split(), None]
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (apart[d], len(w), sum(x in counts for x in w), sum(counts.values()))
        assert got[d].base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / scale) for x in w), rel=1e-9)
        assert got[d].score < 0


def test_context_tree_is_sequential_weighting(spark):
    """The model's probability of a text is the ratio of context-tree probabilities with and without it, bit by bit."""
    train, text, depth = ["abab ba", "abba", "bab"], "abé", 3

    def bits(t):
        line = b"\xff" * depth + t.encode() + b"\xff"
        for p in range(depth, len(line)):
            for j in range(8):
                yield bytes(reversed(line[p - depth : p])), (1 << j) | (line[p] >> (8 - j)), line[p] >> (7 - j) & 1

    tables = defaultdict(lambda: [0, 0])
    for t in train:
        for context, node, bit in bits(t):
            for d in range(depth + 1):
                tables[context[:d], node][bit] += 1

    def kt(n):
        return math.exp(math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi))

    def weighted(context, node):
        own = kt(tables.get((context, node), [0, 0]))
        if len(context) == depth:
            return own
        below = 1.0
        for (c, m) in list(tables):
            if m == node and len(c) == len(context) + 1 and c[:-1] == context:
                below *= weighted(c, node)
        return (own + below) / 2

    total = 0.0
    for context, node, bit in bits(text):
        before = weighted(b"", node)
        for d in range(depth + 1):
            tables[context[:d], node][bit] += 1
        total += math.log10(weighted(b"", node) / before)
        for d in range(depth + 1):
            tables[context[:d], node][bit] -= 1
        for d in range(depth + 1):
            if tables[context[:d], node] == [0, 0]:
                del tables[context[:d], node]
    rows = [(i, t, False) for i, t in enumerate(train)] + [(9, text, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, apart boolean")
    for table_rows in (10**6, 200):
        got = {r.doc_id: r.score for r in scoring.score(df, depth=depth, held_out=F.col("apart"), table_rows=table_rows).collect()}
        assert got[9] == pytest.approx(total, rel=1e-5)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [base[i % 60] + rng.standard_normal(16) * 0.06 * (i % 5) for i in range(300)]
    data = [(i, [float(v) for v in x], i % 60 % 2) for i, x in enumerate(rows)]
    data += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None], 0), (404, data[3][1], None), (405, data[3][1], 1), (406, data[3][1], 1), (407, [2 * v for v in data[3][1]], 1), (408, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    ok = {i: np.array(v) for i, v, label in data if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in data}
    parents, links = {i: i for i, *_ in data}, Counter()
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.98:
                merge(parents, a, b)
                links.update([a, b])
    assert sum(links.values()) > 100
    assert all((r.n_links, r.component_id, r.kept) == (links[i], root(parents, i), root(parents, i) == i) for i, r in got.items()) and len(got) == len(data)


def test_vectors_in_chunks(spark, monkeypatch):
    """A label of many chunks: whole results, and what is shuffled stays near the size of the vectors."""
    monkeypatch.setattr(vectors, "CHUNK", 1 << 17)
    monkeypatch.setattr(vectors, "SIDE", 1 << 18)
    monkeypatch.setattr(vectors, "SHELF", 1 << 19)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((5000, 64)).astype(np.float32)
    x[1000:1400] = x[999] + rng.standard_normal((400, 64)) * 0.13  # a large group around the threshold
    x[2000:2300] = x[1700:2000] + rng.standard_normal((300, 64)) * 0.1
    x[4990:] = x[999]
    label = np.where(np.arange(5000) < 2600, 0, np.arange(5000) % 2)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    df = textops.stored(df, "many")
    moved = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True))))[1]
    before = moved()
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert moved() - before < 2.5 * x.nbytes
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    parents = {i: i for i in range(5000)}
    for a, b in zip(*np.nonzero(near), strict=True):
        merge(parents, int(a), int(b))
    assert near.sum() > 20_000
    assert all((r.n_links, r.component_id, r.kept) == (near[i].sum(), root(parents, i), root(parents, i) == i) for i, r in got.items()) and len(got) == 5000


def test_licences(docs, texts):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    phrases = {tuple(p.encode().split()): label for p, label in licences.PHRASES.items()}
    for d, t in texts.items():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        r = got[d]
        assert (r.n_words, r.n_base, sorted(r.base_labels)) == (len(w), len(places), sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_matching_statistics(spark):
    rng = np.random.default_rng(1)
    templates = [rng.integers(0, 4, 30).tolist() for _ in range(3)]
    machine = licences.Automaton(templates)
    text = rng.integers(0, 5, 200).tolist()
    inside = lambda x: any(x == t[i : i + len(x)] for t in templates for i in range(len(t) - len(x) + 1))
    for start, size, places in machine.matches(text, 2):
        part = text[start : start + size]
        assert inside(part) and not (start and inside(text[start - 1 : start + size])) and not (start + size < len(text) and inside(text[start : start + size + 1]))
        assert all(templates[t][at : at + size] == part for t, at in places.items())
    text = "Intro words. " + licences.TEMPLATES[2][1].replace("Software", "Program") + " tail"
    df = spark.createDataFrame([(1, text), (2, "permission is hereby granted")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan(df).collect()}
    assert rows[1].labels == ["mit"] and rows[1].spans[0].start_word == 2 and rows[1].spans[0].covered > 0.9 and rows[2].labels == []


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    order = sorted(texts)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, r = texts[d], got[d]
        k = len(t) // 2
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - k] + texts[after][:k]).encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert got[1007].fingerprint == got[1008].fingerprint == got[5].fingerprint and got[1007].near_next == 1
    long = [r for d, r in got.items() if r.n_chars > 1000 and d < 1000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_interior_phrases_ignore_offsets():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    a, b = (fingerprints.fingerprints([bytes(rng.integers(97, 123, n).astype(np.uint8)) + shared])[0] for n in (17, 31))
    assert fingerprints.likeness(a, b) > 0.85


@pytest.mark.parametrize("ranks", [None, "tiktoken"])
def test_packing(docs, texts, ranks):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(textops.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    rows = packing.pack(docs, textops.tokenizer_path(), segments=16, loss_share=0.75, loss_limit=896, ranks=ranks and textops.tokenizer_path(ranks)).collect()
    sequences, of = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append(r)
        of[r.doc_id].append(r)
    for pieces in of.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == pieces[0].doc_tokens
    waste = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(pieces) <= 16 and sum(r.loss_tokens for r in pieces) <= 896
        waste += 0 if at & (at - 1) == 0 else 1024 - at
    assert sum(r.loss_tokens for r in rows) == sum(math.ceil(0.75 * len(x)) for x in ids.values())
    assert len(of) == len(texts) and waste <= 0.01 * sum(map(len, ids.values()))


def test_packing_limits():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 3000, 400)
    loss = (tokens * rng.uniform(0, 1, 400)).astype(int)
    loss[:40], loss[40:80] = 0, tokens[40:80]
    for size, segments, limit in ((1024, 8, 600), (1024, 1, 1024), (64, 3, 1), (1, 1, 1)):
        placed = defaultdict(list)
        for sequence in packing.fill(tokens, loss, size, segments, limit):
            bearing = sum(max(0, min(n, at + n - (int(tokens[i]) - int(loss[i])))) for i, at, n in sequence)
            assert 0 < sum(n for *_, n in sequence) <= size and 0 < len(sequence) <= segments and bearing <= limit
            for i, at, n in sequence:
                placed[i].append((at, n))
        for i, pieces in placed.items():
            pieces.sort()
            assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) == tokens[i]
        assert len(placed) == len(tokens)


@pytest.mark.parametrize("limits", [{"segments": 0}, {"loss_limit": 0}, {"size": 0}, {"loss_share": 2}])
def test_packing_refuses(docs, limits):
    with pytest.raises(ValueError):
        packing.pack(docs, textops.tokenizer_path(), **limits)


def test_parts_are_encoded_alone():
    """Odd white space, letters of all widths, added tokens and line ends, against the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(textops.tokenizer_path()), np.random.default_rng(8)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "\u00a0", "\u2003", "\u3000", "\u0085", "\r\n", "\x1c", "\x00", "é", "ß", "ж", "語", "😀", "a", "The", "'s", "'", "12", "...", "<|endoftext|>", "don't", "ﬁ"]
    texts = ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 14))) for _ in range(3000)] + ["w" * 70000 + " x", ""]
    for ranks in (None, textops.tokenizer_path("tiktoken")):
        encoder = packing.Encoder(textops.tokenizer_path(), ranks, most=2000)
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            data = [t.encode() for t in some]
            ids, bounds = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]))
            for k, t in enumerate(some):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t


def test_language(spark, docs):
    model = language.fit(docs)
    rows = [(1, "the of and", "en"), (2, None, None), (3, "123 !!", "de"), (4, "", "fr")]
    odd = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: r for r in language.identify(odd, model, "id", "text", declared_col="lang").collect()}
    assert got[1].lang == "en" and all(got[i].lang == "und" and got[i].rejected for i in (2, 3, 4))
    held = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id >= 120")
    found = language.identify(held.select("doc_id", "text", "source"), model, "doc_id", "text", host_col="source").join(held.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert np.mean([r.lang == r.true for r in found]) > 0.95 and not any(r.rejected for r in found)
    pages = queries.op3_language_evidence(spark, FOLDER).collect()
    assert len(pages) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    evidence = language.identify(spark.createDataFrame([(i, "<html lang=fr><p>le</p>", f"http://a.example.org/fr/{i}") for i in range(30)], "id int, h string, u string"), model, "id", "h", url_col="u", is_html=True).collect()
    assert {r.lang for r in evidence} == {"fr"} and {(r.declared, r.suffix, r.host) for r in evidence} == {("fr", "org/fr", "a.example.org")}


CELLS = [("a", "x", "p", 10), ("a", "y", "p", 30), ("b", "x", "q", 20), ("b", "y", "p", 40), ("a", "x", "q", 5), ("b", "y", "q", 8), ("b", "x", "p", 9), ("a", "y", "q", 7)]


def raked(spark, targets, **k):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    return mixing.rake(cells, {d: spark.createDataFrame([(k, float(v)) for k, v in t.items()], f"{d} string, target double") for d, t in targets.items()}, **k)


def test_raking_within_bounds(spark):
    targets = {"source": {"a": 48, "b": 40}, "lang": {"x": 38, "y": 50}, "topic": {"p": 56, "q": 32}}
    got, error = raked(spark, targets)
    rows = got.collect()
    assert error < 1e-9 and all(0 <= r.fitted <= r.tokens for r in rows) and any(r.fitted == r.tokens for r in rows)
    for d, t in targets.items():
        for k, v in t.items():
            assert sum(r.fitted for r in rows if r[d] == k) == pytest.approx(v, rel=1e-6)


@pytest.mark.parametrize("targets", [
    {"source": {"a": 100, "b": 20}, "lang": {"x": 40, "y": 80}, "topic": {"p": 80, "q": 40}}, {"source": {"a": 40}, "lang": {"x": 20, "y": 20}, "topic": {"p": 20, "q": 20}},
    {"source": {"a": 20, "b": 20, "c": 5}, "lang": {"x": 20, "y": 25}, "topic": {"p": 25, "q": 20}}, {"source": {"a": 20, "b": 20}, "lang": {"x": 20, "y": 25}, "topic": {"p": 25, "q": 20}},
], ids=["more than there is", "a value without target", "a target without cells", "sums that differ"])
def test_raking_refuses(spark, targets):
    with pytest.raises(ValueError):
        raked(spark, targets)


def test_sample_meets_its_targets(spark):
    """Expected tokens are within 1 % of the targets, and the sample's tokens within what chance allows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = mixing.mix(docs.withColumn("mix_topic", F.lit("other")))
    every = mixing.mix(docs, share=1.0).select("doc_id", "mix_topic", "mix_tokens")
    p = kept.groupBy("source", "lang", "mix_topic").agg(F.first("mix_probability").alias("p"), F.first("mix_error").alias("e"))
    rows = docs.select("doc_id", "source", "lang").join(every, "doc_id").join(p, ["source", "lang", "mix_topic"], "left").join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").fillna(0).collect()
    total = sum(r.mix_tokens for r in rows)
    assert len(rows) == 10000 and max(r.e for r in rows) < 1e-9
    for d in ("source", "lang", "mix_topic"):
        of = defaultdict(float)
        for r in rows:
            of[r[d]] += r.mix_tokens
        want, factor = dict.fromkeys(of, 0.0), 0.0
        for _ in range(50):
            low = {k for k, m in of.items() if m <= factor * m**0.7}
            factor = (total / 2 - sum(of[k] for k in low)) / sum(m**0.7 for k, m in of.items() if k not in low)
        for k, m in of.items():
            want[k] = min(m, factor * m**0.7)
            own = [r for r in rows if r[d] == k]
            assert sum(r.p * r.mix_tokens for r in own) == pytest.approx(want[k], rel=0.01)
            spread = math.sqrt(sum(r.p * (1 - r.p) * r.mix_tokens**2 for r in own))
            assert abs(sum(r.mix_tokens for r in own if r.kept) - want[k]) <= 5 * spread + 1e-6 * want[k]


def test_mixing_against_sql(spark, docs):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = sorted(c.sql(queries.SQL["op5_mixture"]).fetchall())
    got = queries.op5_mixture(spark, FOLDER).select("doc_id", "source", "lang", "topic", "n_tokens", "probability")
    columns = c.sql(queries.SQL["op5_mixture"]).columns
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == want
    assert set(docs.columns) < set(mixing.mix(docs).columns)
    topics = {"a": ("x", "y"), "b": ("z",)}
    odd = spark.createDataFrame([(1, "x z z"), (2, "xy z"), (3, "x z"), (4, None), (5, "")], "doc_id long, text string").selectExpr("*", "null as source", "null as lang", "'mine' as topic", "1 as tokens", "2 as mix_tokens")
    got = {r.doc_id: r for r in mixing.mix(odd, share=1.0, topics=topics).collect()}
    assert {k: (r.mix_topic, r.mix_tokens, r.topic, r.tokens) for k, r in got.items()} == {1: ("b", 3, "mine", 1), 2: ("a", 2, "mine", 1), 3: ("a", 2, "mine", 1), 4: ("prose", 0, "mine", 1), 5: ("prose", 0, "mine", 1)}


def test_tool_calls(spark):
    calls = [
        ("a", "add", '{"y": 2.0, "x": 1}', None, 0), ("b", "add", '{"x": 1, "y": "2"}', ["a"], 1), ("c", "add", '{"x": 1, "y": 3}', ["b", "a"], 2), ("d", "nope", "{}", None, 3), ("e", "add", "{bad", None, 4),
        ("f", "add", '{"x":1,"y":1}', ["g"], 5), ("g", "add", '{"x":1,"y":1}', ["f"], 6), ("h", "add", '{"x":1,"y":1}', ["zz"], 7), (None, "add", None, None, 8),
    ]
    results = [("a", "3", 1), ("a", "later", 5), ("b", "x", 2), ("c", "é", 3), (None, "lost", 4)]
    schema = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "number"}}}}
    got = {r.call_id: r for r in toolcalls.link(spark.createDataFrame(calls, "call_id string, name string, arguments string, after array<string>, place long"), spark.createDataFrame(results, "call_id string, content string, place long"), schema).collect()}
    assert {k: (r.status, r.level) for k, r in got.items()} == {"a": ("ok", 0), "b": ("invalid_arguments", 1), "c": ("ok", 2), "d": ("unknown_tool", 0), "e": ("bad_json", 0), "f": ("cycle", None), "g": ("cycle", None), "h": ("missing_dependency", None), None: ("invalid_arguments", 0)}
    assert got["a"].json == '{"after":[],"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and got["a"].n_results == 2
    assert json.loads(got["c"].json)["result"] == "é"


def test_pipeline(spark, tmp_path, docs, texts):
    import corpus_pipeline as p

    docs.select(*p.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    stage, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, f in p.STAGES:
        stage = f(spark, stage, str(tmp_path))
        stage.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in stage.select("doc_id").collect()}
        assert name == "packing" or stage.columns == list(p.COLUMNS)
    assert set(texts) - kept["language"] == {d for d, t in texts.items() if not re.search(r"[a-zà-ÿ]", t.lower())}
    assert {1007, 1008} & kept["near_copies"] == set() and 5 in kept["near_copies"]
    assert kept["near_copies"] >= kept["repeats"] >= kept["mixing"] == kept["packing"]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline", "op3_language_evidence", "op6_tool_calls", "op4_vector_groups"}))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_empty_tables_of_other_kinds(spark, tmp_path):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("op3_language_evidence", "op6_tool_calls", "op4_vector_groups"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_language_rejects_other_languages(spark):
    held = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(held)
    rng = np.random.default_rng(7)
    texts = [
        "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        base64.b64encode(rng.bytes(400)).decode(),
        "".join(chr(x) for x in rng.integers(97, 123, 300)),
    ]
    planted = spark.createDataFrame([(-1 - i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = language.identify(held.select(*planted.columns).union(planted), model, "doc_id", "text", declared_col="lang", host_col="source").collect()
    letters = {r.doc_id for r in found if r.n_letters}
    assert {r.doc_id for r in found if r.rejected and r.doc_id in letters} == {-1 - i for i in range(len(texts))}
    assert all(r.lang == "und" and r.probability == 0 for r in found if r.doc_id < 0)


def test_language_posterior_limit(spark):
    model = language.fit(spark.createDataFrame([("abc abc abc", "x"), ("abc abc abc", "y")], "text string, lang string"))
    rows = spark.createDataFrame([(1, "abc abc")], "id long, text string")
    assert language.identify(rows, model, "id", "text", least=0.2).first().rejected and not language.identify(rows, model, "id", "text", least=0.0).first().rejected


def test_declared_language_anywhere_in_the_page(spark, docs):
    late = '<?xml version="1.0"?><!-- ' + "licence " * 2000 + '<html lang="de"> --><script>var x = "<html lang=es>"</script>' + " " * 5000 + '<html class="a" lang="fr"><p>le</p></html>'
    pages = spark.createDataFrame([(1, late), (2, "<p>le</p>" * 1000)], "id int, h string")
    got = {r.id: r.declared for r in language.identify(pages, language.fit(docs), "id", "h", is_html=True).collect()}
    assert got == {1: "fr", 2: None}


def test_tool_results_without_a_call_and_all_results(spark):
    calls = spark.createDataFrame([("a", "add", "{}", None, 0), ("b", "add", "{}", ["a"], 4)], "call_id string, name string, arguments string, after array<string>, place long")
    results = spark.createDataFrame([("a", "late", 9), ("a", "first", 1), ("x", "2", 6), ("x", "1", 5), (None, "lost", 3), (None, "gone", 2)], "call_id string, content string, place long")
    got = sorted(((r.call_id, r.status, r.place, r.level, r.n_results, r.result, r.results) for r in toolcalls.link(calls, results, {"add": {"type": "object"}}).collect()), key=str)
    assert got == sorted([
        ("a", "ok", 0, 0, 2, "first", ["first", "late"]), ("b", "no_result", 4, 1, 0, None, []), ("x", "no_call", 5, None, 2, "1", ["1", "2"]),
        (None, "no_call", 3, None, 1, "lost", ["lost"]), (None, "no_call", 2, None, 1, "gone", ["gone"]),
    ], key=str)


def test_answers_belong_to_the_latest_user_turn(spark):
    roles = {1: "aua asuuaa", 2: "u" + "a" * 700, 3: "u" + " " * 900 + "a"}
    rows = [(c, t, {"u": "user", "a": "assistant", "s": "system"}[x], f"{x}{t}") for c, line in roles.items() for t, x in enumerate(line) if x != " "]
    calls, results = toolcalls.calls_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = Counter()
    for c, line in roles.items():
        for t, x in enumerate(line):
            if x == "a":
                asked = line.rfind("u", 0, t)
                want[f"{c}:{asked}" if asked >= 0 else None, f"a{t}"] += 1
    assert Counter((r.call_id, r.content) for r in results.collect()) == want
    rows = toolcalls.link(calls, results, toolcalls.TURN_SCHEMAS).collect()
    assert sum(r.n_results for r in rows) == sum(want.values()) and {r.status for r in rows if r.call_id is None} == {"no_call"}


def test_packing_added_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(textops.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "one <|endoftext|>\n two", " <|endoftext|>  <|endoftext|> end", "plain words here"]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), textops.tokenizer_path(), ranks=textops.tokenizer_path("tiktoken")).collect()
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))


@pytest.mark.parametrize("n", [40, 130])
def test_every_label_is_fitted(spark, n):
    rng = np.random.default_rng(9)
    words = ["".join(chr(c) for c in rng.integers(97, 123, 6)) for _ in range(8 * n)]
    say = lambda k, m: " ".join(words[8 * k + int(i)] for i in rng.integers(0, 8, m))
    rows = [(f"l{k:03}", say(k, 30)) for k in range(n) for _ in range(2 + (k < 32))]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model[0] == [f"l{k:03}" for k in range(n)]
    held = spark.createDataFrame([(k, say(k, 20)) for k in range(n)], "id int, text string")
    got = {r.id: r for r in language.identify(held, model, "id", "text").collect()}
    assert all(got[k].lang == f"l{k:03}" and not got[k].rejected for k in range(n))


def test_removals_come_from_the_automata(docs, monkeypatch):
    monkeypatch.setattr(repeats, "automata", lambda keys, phrase: [])
    assert repeats.remove_repeats(docs, 5).agg(F.sum("n_removed")).first()[0] == 0


def test_names_of_structured_words():
    """Words, windows and shingle sets of the Thue-Morse sequence and its complement have different names."""
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 12)], np.uint8)
    for n in (64, 1024, 4096):
        a, b = bits[:n] + 97, 98 - bits[:n]
        buf = np.r_[a, 32, b].astype(np.uint8)
        assert len(set(textops.word_hashes(buf, np.array([0, n + 1]), np.array([n, 2 * n + 1])).tolist())) == 2
        words = np.array([7, 9], np.uint64)
        x, y = words[bits[:n]], words[1 - bits[:n]]
        assert textops.window_hashes(x, n)[0] != textops.window_hashes(y, n)[0]
        assert len(set(textops.window_hashes(np.r_[x, y], n).tolist())) == n + 1


def test_odd_json_of_tool_calls(spark):
    calls = [("big", "add", '{"x": ' + "9" * 400 + "}", None, 0), ("half", "add", '{"x": "\\ud800"}', [None, "big"], 1), ("key", "add", '{"\\ud800": 1}', None, 2), ("list", "many", '{"x": null}', None, 3), ("inf", "add", '{"x": 1e999}', None, 4), ("deep", "add", "[" * 100000, None, 5), ("real", "many", '{"x": 1.5}', None, 6)]
    results = spark.createDataFrame([("big", "r", 0)], "call_id string, content string, place long")
    schemas = {"add": {"type": "object", "additionalProperties": False, "properties": {"x": {"type": "integer"}}}, "many": {"properties": {"x": {"type": ["string", "null"]}}}}
    got = {r.call_id: r for r in toolcalls.link(spark.createDataFrame(calls, "call_id string, name string, arguments string, after array<string>, place long"), results, schemas).collect()}
    assert {k: r.status for k, r in got.items()} == {"big": "ok", "half": "missing_dependency", "key": "bad_json", "list": "no_result", "inf": "bad_json", "deep": "bad_json", "real": "invalid_arguments"}
    assert json.loads(got["big"].json)["arguments"]["x"] == int("9" * 400) and got["half"].json is None


def test_levels_against_brute_force(spark):
    rng = np.random.default_rng(6)
    after = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(700)}
    for k in range(300):
        after[f"r{k}"] = sorted({f"r{int(j)}" for j in rng.integers(0, max(1, k), int(rng.integers(0, 4)))} if k else set()) + (["c50"] if k % 50 == 7 else [])
    after |= {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "m": ["gone"], "n": ["m", "c3"], "s": ["s"]}
    want = {}
    while new := {k: max((want[d] + 1 for d in a), default=0) for k, a in after.items() if k not in want and all(d in want for d in a)}:
        want |= new
    df = spark.createDataFrame([(k, a) for k, a in after.items()], "call_id string, after array<string>")
    assert {r.call_id: r.level for r in toolcalls.levels(df).collect()} == want and len(want) == 1000


def test_markup_is_read_in_one_pass():
    import time

    for page in ("<!--" * 250_000, "<script " * 130_000, "<script>" * 130_000, "<" * 10**6, "<html " * 10**5 + "lang=", "<a>" * 300_000, "<!-- --> <nav>x</nav>" * 40_000):
        began = time.process_time()
        language.read_markup(page)
        assert time.process_time() - began < 1
    page = '<!-- <html lang="es"> --><HTML class=a LANG="fr"><script>var a = "<b>"</script><style>p</style><nav>menu</nav ><p>le &eacute;t&eacute;</p><!-- open <b>bold'
    text, declared = language.read_markup(page)
    assert declared == "fr" and text.split() == ["le", "été", "bold"]


def test_posterior_against_brute_force(spark, docs):
    """Evidence of the text, the declared language, the suffix and the host, each without the page's own say."""
    names, blocks, _ = model = language.fit(docs)
    table = np.concatenate([b.value for b in blocks])
    table = np.log(table / table.sum(1, keepdims=True))
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id >= 120").limit(40).collect()
    pages = [(i, r.text[:80], [None, "de", "en", "xx"][i % 4], f"http://h{i % 5}.d{i % 3}.{['org', 'fr'][i % 2]}/{['', 'de/'][i % 2]}x") for i, r in enumerate(rows)]
    got = {r.id: r for r in language.identify(spark.createDataFrame(pages, "id int, text string, declared string, url string"), model, "id", "text", declared_col="declared", url_col="url").collect()}
    q, logits, keys = [], [], []
    for i, text, declared, url in pages:
        data = text.encode()
        code, _, _ = language.trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        logit = 0.25 * table[:, code].sum(1)
        logits.append(logit - logit.max())
        q.append(np.exp(logits[-1]) / np.exp(logits[-1]).sum() * (got[i].text_lang != "und"))
        keys.append((declared, got[i].suffix, ".".join(got[i].host.split(".")[-2:]), got[i].host))
    for i, *_ in pages:
        others = [k for k in range(len(pages)) if k != i]
        whole = sum(q[k] for k in others) + 1.0
        p = whole / whole.sum()
        for level in (1, 2, 3):
            x = sum((q[k] for k in others if keys[k][1 : level + 1] == keys[i][1 : level + 1]), np.zeros(len(names))) + 20.0 * p
            p = x / x.sum()
        score = logits[i] + np.log(p)
        if keys[i][0]:
            score = score + np.log((sum((q[k] for k in others if keys[k][0] == keys[i][0]), np.zeros(len(names))) + 1.0) / whole)
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        if got[i].text_lang != "und":
            assert got[i].lang == names[int(post.argmax())] and got[i].probability == pytest.approx(post.max(), rel=1e-6)


def test_null_ids(spark, docs):
    """Rows whose ids are null or equal are rows like others."""
    base = docs.filter("doc_id in (3, 5, 8)").collect()
    rows = [(None, base[0].text), (None, base[1].text), (None, base[0].text), (7, base[0].text), (7, base[2].text), (7, None), (None, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(odd).collect())
    assert found == Counter({(7, 7): 3, (None, 7): 2, (None, None): 2})
    kept = repeats.remove_repeats(odd).collect()
    assert len(kept) == 7 and sum(r.n_removed for r in kept) == 2 * len(base[0].text.split()) if len(base[0].text.split()) >= 50 else len(kept) == 7
    assert len(scoring.score(odd).collect()) == len(licences.scan(odd).collect()) == len(fingerprints.edited_likeness(odd).collect()) == 7
    assert {r.doc_id for r in packing.pack(odd, textops.tokenizer_path()).collect()} == {7, None}
    model = language.fit(docs)
    assert len(language.identify(odd, model, "doc_id", "text", host_col="source").collect()) == 7
    assert 0 < mixing.mix(odd, share=1.0).count() <= 7
    vecs = spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [2.0, 0.1], 0), (None, None, 0)], "vec_id long, embedding array<double>, label int")
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(vecs).collect()) == Counter({(None, 2, 4): 1, (4, 2, 4): 2, (None, 0, None): 1})


def test_vectors_at_the_threshold(spark):
    """Cosines of exactly 0.98 link, those just below don't; many copies and near copies are counted, never paired."""
    exact = [(1, [1.0, 0.0]), (2, [0.98, math.sqrt(1 - 0.98**2)]), (3, [0.9799, -math.sqrt(1 - 0.9799**2)])]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in exact], "vec_id long, embedding array<double>, label int")).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    assert got == {i: sum(cosine(v, w) >= 0.98 for j, w in exact if j != i) for i, v in exact}
    rng = np.random.default_rng(3)
    center = rng.standard_normal(16)
    near = [(i, (center + rng.standard_normal(16) * (0.001 if i % 2 else 0)).tolist(), 0) for i in range(3000)]
    rows = vectors.near_vectors(spark.createDataFrame(near, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(2999, 0)}
