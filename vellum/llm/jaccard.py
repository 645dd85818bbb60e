"""N-gram Jaccard join with adaptive multi-match prefixes (operator 9).

Exact set similarity join of word shingles: documents link when |A & B| / |A | B| >= num / den.

1. One pass over the whole texts gives each document's number of shingles and the name of its shingle set, and
   counts, over all documents, in how many each of 2**21 shingle classes occurs (a table of fixed size).
2. Equal sets are one node from here on; copies never become pairs.
3. Shingles are ordered by (class count, name): any order gives exact results, rare first gives few candidates.
   With overlap >= a = ceil(t*|A|), two sets share at least l shingles among the first |A| - a + l of each. Each
   set picks its own l from a ladder: the cost of a longer prefix against the expected candidates, the sum of
   class counts in the prefix over l. A pair needs an overlap of o = ceil(t * (|A| + |B|) / (1 + t)), so it must share
   min(l, l') shingles whose places in the two orders are among the first |A| - o + min(l, l') and |B| - o + min(l, l').
   A set stays with a shingle only where another set of the shingle has a size that it may link with.
4. Every set with a shared prefix shingle is verified against the shingle's first document; verified links are
   merged. Only pairs whose sets are still in different components go on.
5. Where a shingle of few sets has several components, its sets are joined, with the multi-match requirement counted per
   pair. A pair is left out only where it can't link: its parity words (512 bits, each the parity of the shingles that
   hash to it) differ in more bits than the sets may differ in shingles, or its first common shingle comes too late.
6. A shingle of many sets has a reference, the one of them with most such shingles, so that near copies have nearly all the
   same. D is what only a set or only its reference has. |D| tells whether the two link; two sets differ in
   |D| + |D'| - 2 * |D & D'| shingles. Sets near the reference are one component with it, so a pair between components has
   one that is far: |D'| > g * (n' + r), with g = (den - num) / (num + den) and r the size of the reference. The pair links
   only with |D & D'| > (|D| + g * (r - n)) / 2, as links differ in at most g * (n + n') shingles. That is more than 0,
   and usually half of D, so pairs come from a prefix join of the D, rarest first: edits of one copy alone come
   first and meet nothing. Pairs with a shingle of many sets in common need no count of shingles; what the joins give is
   verified exactly, and no link between components is lost.

Edge cases: null and empty texts have no shingles and link with nothing; texts with fewer than n words are one
shingle; ties and repeated rows are equal sets; null ids are larger than all others; very long texts are sets like others;
an empty table gives an empty result; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from .textops import LOWER, U, components, dropped, mix, shingle_sets, slices, small_batches, stored, tidy

CLASS_BITS, BLOCKS = 21, 128
BLOCK_ROWS, FEW = 1000, 50
PARITY = [f"b{k}" for k in range(8)]


def _sets(batch, n, lower):
    for at, buf, offs in slices(batch.column("text")):
        for k, s in enumerate(shingle_sets(LOWER[buf] if lower else buf, offs, n)):
            yield at + k, s


def set_name(s: np.ndarray) -> int:
    return int((mix(s).sum(dtype=U) ^ mix(np.array([len(s)], U))[0]).astype(np.int64)) if len(s) else 0


def overlap_needed(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def parity(s: np.ndarray) -> np.ndarray:
    """Eight words whose bits are the parities of the shingles that hash to them; two sets' differ in at most as many
    bits as the sets do in shingles."""
    odd = np.bincount((mix(s ^ U(0xA5A5A5A5A5A5A5A5)) >> U(64 - 9)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles of the chosen prefix in order, and the chosen l."""
    n = len(s)
    often = counts[(s >> U(64 - CLASS_BITS)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((s, often))
    base = n - overlap_needed(n, num, den) + 1
    most = max(1, min(n - base + 1, base))
    seen = np.cumsum(np.maximum(often[order] - 1, 0))
    best, cost = 1, None
    ell = 1
    while ell <= most:
        p = base + ell - 1
        c = p + 0.2 * seen[p - 1] / ell
        if cost is None or c < cost:
            best, cost = ell, c
        ell = max(ell + 1, ell * 3 // 2)
    return s[order[: base + best - 1]], best


def jaccard_components(df, n: int = 5, num: int = 8, den: int = 10, lower: bool = True, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest linked doc_id)."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))  # tells rows apart whose ids are equal or null

    def sketch(batches):
        table = np.zeros(1 << CLASS_BITS, np.uint32)
        for batch in batches:
            rows, sizes, sids, bits = [], [], [], []
            for r, s in _sets(batch, n, lower):
                rows.append(r)
                sizes.append(len(s))
                sids.append(set_name(s))
                bits.append(parity(s))
                np.add.at(table, (s >> U(64 - CLASS_BITS)).astype(np.int64), 1)
            if rows:
                m = len(rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("doc").take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), *[pa.array(b) for b in np.array(bits).T.copy()], pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "doc", "n", "sid", *PARITY, "block", "counts"])
        if table.any():
            z = zstandard.ZstdCompressor(3)
            parts = [z.compress(p.tobytes()) for p in np.split(table, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64())] * (4 + len(PARITY)) + [pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "doc", "n", "sid", *PARITY, "block", "counts"])
        tidy()

    def add_up(key, rows):
        total = np.zeros((1 << CLASS_BITS) // BLOCKS, np.uint64)
        for part in rows.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(part), np.uint32)
        part = zstandard.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([part], pa.binary())})

    words = "".join(f"{b} long, " for b in PARITY)
    both = stored(docs.mapInArrow(sketch, f"doc_id long, doc long, n long, sid long, {words}block int, counts binary"), "sketch")
    members = both.filter("block is null").select("doc_id", "n", "sid")
    firsts = both.filter("block is null and n > 0").groupBy("sid").agg(F.min("doc").alias("doc"))
    parities = both.filter("block is null and n > 0").select("sid", *PARITY)
    tables = both.filter("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    tables = tables.groupBy("block", "part").applyInArrow(add_up, "block int, counts binary").groupBy("block").applyInArrow(add_up, "block int, counts binary")
    counts = np.zeros(1 << CLASS_BITS, np.uint32)
    width = len(counts) // BLOCKS
    for row in tables.collect():  # 2**21 numbers at any size of input
        counts[row.block * width : (row.block + 1) * width] = np.frombuffer(zstandard.decompress(bytes(row.counts)), np.uint32)
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        seen: set[int] = set()
        table = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for _, s in _sets(batch, n, lower):
                sid = set_name(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                tokens, ell = prefix(s, table, num, den)
                k = len(tokens)
                for c, v in zip(cols, (tokens.astype(np.int64), np.full(k, sid), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32), np.full(k, ell, np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "sid", "n", "pos", "ell"])
        tidy()

    token = Window.partitionBy("token")
    rows = docs.mapInArrow(prefixes, "token long, sid long, n int, pos int, ell int")
    rows = rows.repartition("token").groupBy("token", "sid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("ell").alias("ell"))
    # a set that meets none of a size that it may link with does so neither where its nearest in size are too far
    by_size = token.orderBy("n")
    size = F.col("n").cast("long")
    rows = rows.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
    rows = rows.filter((F.col("less").cast("long") * den >= size * num) | (size * den >= F.col("more").cast("long") * num)).drop("less", "more")
    rows = stored(rows.withColumn("lead", F.min(F.struct("sid", "n", "pos", "ell")).over(token)), "prefix")

    n_a, n_b = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    needed_overlap = F.ceil((n_a + n_b) * num / F.lit(num + den))
    asked = F.least("ell_a", "ell_b")
    fits = (n_a * den >= n_b * num) & (n_b * den >= n_a * num)
    fits &= (F.col("pos_a") < n_a - needed_overlap + asked) & (F.col("pos_b") < n_b - needed_overlap + asked)
    differ = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in PARITY), F.lit(0))
    similar = differ <= n_a + n_b - 2 * needed_overlap

    def enough(pairs):
        """Pairs a < b that share as many prefix shingles as asked for; first_a, first_b: the place of the first one."""
        two = lambda x, y: F.shiftleft(F.col(x).cast("long"), 32).bitwiseOR(F.col(y).cast("long"))
        low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        # narrow rows, as there are many: the first common shingle is the same in both orders
        shared = pairs.filter(fits).select("a", "b", asked.alias("asked"), two("n_a", "n_b").alias("n"), two("pos_a", "pos_b").alias("pos"))
        shared = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("asked").alias("asked"), F.max("n").alias("n"), F.min("pos").alias("pos")).filter("shared >= asked")
        high = lambda c: F.shiftright(c, 32).cast("int")
        return shared.select("a", "b", high("n").alias("n_a"), low("n").alias("n_b"), high("pos").alias("first_a"), low("pos").alias("first_b"))

    swap = F.col("sid") > F.col("lead.sid")
    pick = lambda own, lead: F.when(swap, F.col(lead)).otherwise(F.col(own))
    star = rows.filter(F.col("sid") != F.col("lead.sid")).select(
        *[F.when(swap, F.col(f"lead.{c}")).otherwise(F.col(c)).alias(f"{o}a") for c, o in (("sid", ""), ("n", "n_"), ("pos", "pos_"), ("ell", "ell_"))],
        *[F.when(swap, F.col(c)).otherwise(F.col(f"lead.{c}")).alias(f"{o}b") for c, o in (("sid", ""), ("n", "n_"), ("pos", "pos_"), ("ell", "ell_"))],
    )
    star = stored(enough(star).select("a", "b", "n_a", "n_b"), "pairs")
    firsts = stored(firsts, "firsts")
    own = docs.select("doc", "text")

    def of_texts(batches):
        for batch in batches:
            sids = batch.column("sid").to_pylist()
            got = [(sids[r], s.astype(np.int64)) for r, s in _sets(batch, n, lower) if set_name(s) == sids[r]]
            if got:
                lengths = np.cumsum([0] + [len(s) for _, s in got])
                values = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([s for _, s in got])))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), values], ["sid", "items"])
        tidy()

    def sets_of(pairs):
        """The shingle sets of the members of pairs, found again from their first documents' texts. A filter of 2**22
        bits, a fixed size, spares most other texts the shuffle; the join decides."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(firsts, "sid")
        needed = stored(needed, "needed")
        bit = F.pmod(F.xxhash64("doc"), F.lit(1 << 22)).alias("bit")
        bits = np.zeros(1 << 22, bool)
        bits[needed.select(bit).distinct().toArrow().column("bit").to_numpy()] = True
        sent = df.sparkSession.sparkContext.broadcast(np.packbits(bits))

        def sift(batches):
            ok = np.unpackbits(sent.value).astype(bool)
            for batch in batches:
                yield batch.filter(pa.array(ok[batch.column("bit").to_numpy()]))
            tidy()

        near = own.withColumn("bit", bit).mapInArrow(sift, "doc long, text string, bit long").drop("bit")
        # shuffled even where one side is small, so that no task needs two Python workers at a time
        near = near.join(needed.hint("merge"), "doc").select("sid", "text")
        return stored(near.mapInArrow(of_texts, "sid long, items array<long>"), "sets")

    def with_sets(pairs, sets):
        left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("items_a")), "a")
        return left.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("items_b")), "b")

    def verified(pairs):
        meet = F.size(F.array_intersect("items_a", "items_b")).cast("long")
        full = with_sets(pairs, sets := sets_of(pairs)).select("a", "b", meet.alias("meet"), "n_a", "n_b")
        links = full.filter(F.col("meet") * den >= (F.col("n_a") + F.col("n_b") - F.col("meet")).cast("long") * num).select("a", "b")
        links = stored(links, "links")
        dropped(sets)
        return links

    links = verified(star)
    labels = components(links)

    # What is left: pairs in different components.
    def apart(labels):
        """The prefix rows of shingles that occur in several components, with the parity words."""
        marked = rows.drop("lead").join(labels, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "sid")).drop("node")
        marked = stored(marked, "marked")
        mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo <> hi").select("token", "k")
        mixed = stored(marked.join(mixed, "token").join(parities.dropDuplicates(["sid"]), "sid"), "mixed")
        dropped(marked)
        return mixed

    def differences(hot):
        """One row for each set of a hot shingle and its reference, the shingle's set with most hot shingles: a, n_a, the
        reference b, n_b, and the shingles that only one of the two has."""
        weights = hot.groupBy("sid").agg(F.count(F.lit(1)).alias("weight"))
        tops = hot.join(weights, "sid").groupBy("token").agg(F.max(F.struct("weight", "sid", "n")).alias("top"))
        pairs = hot.join(tops, "token").filter("sid <> top.sid").select(F.col("sid").alias("a"), F.col("top.sid").alias("b"), F.col("n").alias("n_a"), F.col("top.n").alias("n_b")).distinct()
        pairs = stored(pairs, "pairs")
        only = F.concat(F.array_except("items_a", "items_b"), F.array_except("items_b", "items_a"))
        found = with_sets(pairs, sets := sets_of(pairs)).select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), only.alias("only"), F.size(only).cast("long").alias("size"))
        found = found.withColumn("far", F.col("size") * (num + den) > (F.col("n_a") + F.col("n_b")) * (den - num))
        found = stored(found.repartition(-(-pairs.count() // BLOCK_ROWS) or 1, "a"), "differences")  # BLOCK_ROWS sets in a task or so
        dropped(sets)
        return found

    def by_differences(found, sets):
        """Pairs of sets in different components that may link and have a reference in common. sets: label and parity words."""
        token, own = Window.partitionBy("b", "token"), Window.partitionBy("b", "a").orderBy("k", "token")
        x = found.join(sets.select(F.col("sid").alias("a")), "a").select("b", "a", "n_a", "n_b", "size", "far", F.explode("only").alias("token"))
        x = x.withColumn("k", F.count(F.lit(1)).over(token)).withColumn("pos", F.row_number().over(own) - 1).filter("k > 1")
        # links of a set to one that is far from their reference have more than least differences in common
        least = F.floor((F.col("size") * (num + den) + (F.col("n_b") - F.col("n_a")) * (den - num)) / (2 * (num + den)))
        x = x.withColumn("early", F.col("pos") < F.col("size") - least).filter("early or far").select("b", "token", F.col("a").alias("sid"), F.col("n_a").alias("n"), "size", "far", "pos", "early")
        x = stored(x.join(sets, "sid"), "shingles")
        y = x.filter("far").select("b", "token", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "size", "pos", "label", *PARITY)])
        x = x.filter("early").select("b", "token", "far", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "size", "pos", "label", *PARITY)])
        common = F.ceil(((F.col("size_a") + F.col("size_b")) * (num + den) - (n_a + n_b) * (den - num)) / (2 * (num + den)))
        fit = (F.col("label_a") != F.col("label_b")) & (~F.col("far") | (F.col("sid_a") < F.col("sid_b"))) & (n_a * den >= n_b * num) & (n_b * den >= n_a * num)
        fit &= (F.col("pos_a") <= F.col("size_a") - common) & (F.col("pos_b") <= F.col("size_b") - common) & similar
        ends = [F.when(F.col("sid_a") < F.col("sid_b"), F.col(f"{c}_{p}")).otherwise(F.col(f"{c}_{q}")).alias(out) for c, p, q, out in (("sid", "a", "b", "a"), ("sid", "b", "a", "b"), ("n", "a", "b", "n_a"), ("n", "b", "a", "n_b"))]
        return x.join(y, ["b", "token"]).filter(fit).select(*ends).distinct()

    left = apart(labels)
    close = None
    if not (hot := left.filter(F.col("k") > FEW)).isEmpty():
        found = differences(hot)
        links = links.union(stored(found.filter("not far").select("a", "b"), "links"))
        dropped(left)
        labels = components(links)
        left = apart(labels)
        close = by_differences(found, left.filter(F.col("k") > FEW).select("sid", "label", *PARITY).distinct())
    dropped(rows)
    few = left.filter(F.col("k") <= FEW).drop("k")
    x, y = (few.select("token", *[F.col(c).alias(f"{c}_{o}") for c in ("sid", "n", "pos", "ell", "label", *PARITY)]) for o in "ab")
    pairs = x.join(y, "token").filter("sid_a < sid_b and label_a <> label_b").filter(fits & similar)
    pairs = pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), *[f"{c}_{o}" for o in "ab" for c in ("n", "pos", "ell")])
    early = (F.col("first_a") <= n_a - needed_overlap) & (F.col("first_b") <= n_b - needed_overlap)
    rest = enough(pairs).filter(early).select("a", "b", "n_a", "n_b")
    rest = stored(rest if close is None else rest.union(close.select("a", "b", "n_a", "n_b")).distinct(), "pairs")
    more = verified(rest)
    if not more.isEmpty():
        labels = components(links.union(more))

    nodes = members.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    nodes = nodes.join(labels, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "sid"))
    nodes = stored(nodes.filter("n > 0 and (copies > 1 or node is not null)").select("sid", "label", "rep"), "nodes")
    smallest = nodes.groupBy("label").agg(F.min("rep").alias("component"))
    named = stored(nodes.join(smallest, "label").select("sid", "component"), "named")
    return members.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_firsts(df, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text"):
    """The rows of df whose document is the smallest of its component; a document without words is its own."""
    found = jaccard_components(df, n, num, den, id_col=id_col, text_col=text_col)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
