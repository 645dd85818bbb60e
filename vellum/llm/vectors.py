"""Embedding near-dedup by an exact join of chunks (operator 4).

Unit vectors with cosine >= t are within squared distance 2 - 2t, and so are their first dimensions after any rotation. The
vectors of a label are dealt by name into chunks of bounded size. A label of one chunk is done where that is made up. The
chunks of other labels are stored once, and Spark's product of that table with itself reads every two chunks of a label
together: no vector is shuffled more than once, whatever a label's size. A task compares the first dimensions of the
rotated vectors, within a band over one of them, and verifies the cosine of what is left in double precision. Pairs
never leave a task: it returns sums of links per vector and a spanning set of links. Vectors travel as 4-byte numbers where
these hold them exactly.

Equal vectors (of a label) are one node with a count, so a group of copies costs nothing.

Edge cases: vectors that are null, of zero length, all zero, or that hold null or non-finite components, and rows
with a null label link with nothing; vectors of different sizes link with nothing; rows with equal ids count as
different vectors; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql import functions as F

from .textops import U, components, join_roots, mix, stored, thinned, tidy

#: Bytes of a chunk, of what a task reads of either side, and of the chunks that are multiplied with each other.
CHUNK, SIDE, SHELF = 1 << 21, 1 << 25, 1 << 28
LEAD, TILE, WIDE, LINKS = 16, 256, 2048, 200_000


@functools.lru_cache
def rotation(size: int, seed: int = 7) -> np.ndarray:
    """Orthonormal directions, LEAD at most, as columns."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((size, min(size, LEAD))))[0]


def chunk_rows(size: int) -> int:
    return max(256, CHUNK // (4 * size))


def _numbered(batch):
    """For each size of the vectors that can link: rows, sizes, names, kinds (of label and size) and the vectors."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False)
    lengths = np.where(batch.column("label").is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    labels = batch.column("label").dictionary_encode()
    of_label = []
    for label in labels.dictionary.to_pylist():
        letters = np.frombuffer(label.encode(), np.uint8).astype(U) + U(1)
        of_label.append(mix(letters + mix(np.arange(len(letters), dtype=U) + U(1 << 40))).sum(dtype=U))
    of_label = np.array(of_label, U)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        x = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size) + 0.0  # nulls are NaN
        scale = np.abs(x).max(1)
        fine = np.isfinite(scale) & (scale > 0)
        rows, x, scale = rows[fine], x[fine], scale[fine]
        if not len(rows):
            continue
        whose = of_label[labels.indices.take(pa.array(rows)).to_numpy()]
        names = mix(mix(x.view(U) + mix(np.arange(size, dtype=U) + U(1))).sum(1, dtype=U) + whose)
        kinds = mix(whose + mix(np.array([size], U) + U(1 << 41)))
        odd = (scale <= 1e-100) | (scale >= 1e100)
        x[odd] /= scale[odd, None]
        yield rows, int(size), names.astype(np.int64), kinds.astype(np.int64), x


class Chunk:
    """Vectors of one kind in the order of their first rotated dimension."""

    def __init__(self, names: np.ndarray, copies: np.ndarray, v: np.ndarray):
        norms = np.linalg.norm(v.astype(float), axis=1)
        lead = (v @ rotation(v.shape[1])) / norms[:, None]
        order = np.argsort(lead[:, 0])
        self.names, self.copies, self.v, self.norms = names[order], copies[order].astype(float), v[order], norms[order]
        lead = lead[order].astype(np.float32)
        squares, ones = (lead**2).sum(1, keepdims=True), np.ones((len(lead), 1), np.float32)
        self.place = lead[:, 0]
        self.left, self.right = np.hstack([-2 * lead, squares, ones]), np.ascontiguousarray(np.hstack([lead, ones, squares]).T)

    def cosines(self, p: np.ndarray, other: Chunk, q: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.v[p].astype(float), other.v[q].astype(float)) / (self.norms[p] * other.norms[q])


def near_pairs(x: Chunk, y: Chunk, threshold: float):
    """Places in x and y of vectors with cosine >= threshold; x and y have no name in common, or are one chunk, whose pairs
    come once."""
    limit = np.float32(2 - 2 * threshold + 1e-5)
    r = np.sqrt(limit) + 1e-5
    for at in range(0, len(x.names), TILE):
        to = min(at + TILE, len(x.names))
        lo, hi = np.searchsorted(y.place, [x.place[at] - r, x.place[to - 1] + r])
        lo = max(lo, at) if x is y else lo
        for cut in range(lo, hi, WIDE):
            end = min(cut + WIDE, hi)
            near = x.left[at:to] @ y.right[:, cut:end] <= limit
            n = np.count_nonzero(near)
            if not n:
                continue
            if n > near.size // 50:
                cosines = (x.v[at:to].astype(float) @ y.v[cut:end].astype(float).T) / np.multiply.outer(x.norms[at:to], y.norms[cut:end])
                p, q = np.nonzero(cosines >= threshold - 1e-9)
                sure = cosines[p, q] >= threshold + 1e-9
                p, q = p + at, q + cut
                if not sure.all():  # the same sum as for a single pair decides
                    sure[~sure] = x.cosines(p[~sure], y, q[~sure]) >= threshold
            else:
                p, q = np.nonzero(near)
                p, q = p + at, q + cut
                sure = x.cosines(p, y, q) >= threshold
            if x is y:
                sure &= p < q
            if sure.any():
                yield p[sure], q[sure]


class Links:
    """Sums of links of vectors, and links that connect what all found ones do."""

    def __init__(self, threshold: float):
        self.threshold, self.sums, self.tree, self.held = threshold, {}, [], 0

    def add(self, x: Chunk, x_key, y: Chunk, y_key) -> None:
        n_x, same = len(x.names), x is y
        root = np.arange(n_x + (0 if same else len(y.names)))
        sums_x, sums_y = (self.sums.setdefault(key, (c.names, np.zeros(len(c.names))))[1] for c, key in ((x, x_key), (y, y_key)))
        for p, q in near_pairs(x, y, self.threshold):
            sums_x += np.bincount(p, y.copies[q], len(sums_x))
            sums_y += np.bincount(q, x.copies[p], len(sums_y))
            join_roots(root, p, q if same else q + n_x)
        names = x.names if same else np.r_[x.names, y.names]
        tree = np.flatnonzero(root != np.arange(len(root)))
        if len(tree):
            self.tree.append((names[root[tree]], names[tree]))
            self.held += len(tree)
            if self.held > LINKS:
                self.tree = [thinned(*map(np.concatenate, zip(*self.tree, strict=True)))]
                self.held = len(self.tree[0][0]) // 2  # as many again may come

    def found(self) -> pa.Table:
        """a, b: links; a, n: the links of a."""
        none = np.zeros(0, np.int64)
        a, b = thinned(*map(np.concatenate, zip(*self.tree, strict=True))) if self.tree else (none, none)
        of = np.concatenate([none, *[names[sums > 0] for names, sums in self.sums.values()]])
        sums = np.concatenate([none, *[sums[sums > 0].astype(np.int64) for _, sums in self.sums.values()]])
        return pa.table({"a": pa.array(np.r_[a, of]), "b": pa.concat_arrays([pa.array(b), pa.nulls(len(of), pa.int64())]), "n": pa.array(np.r_[np.zeros(len(a), np.int64), sums])})


def near_vectors(df, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield batch.slice(at, 1000)

    def name(batches):
        for batch in parts(batches):
            out = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            fine = np.zeros(batch.num_rows, bool)
            for at, size, names, kinds, _ in _numbered(batch):
                fine[at] = True
                for to, values in zip(out, (names, kinds, size), strict=True):
                    to[at] = values
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array(x, mask=~fine) for x in out]], ["vec_id", "name", "kind", "size"])

    named = stored(rows.mapInArrow(name, "vec_id long, name long, kind long, size long"), "vectors")
    nodes = named.filter("name is not null").groupBy("name", "kind", "size").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "nodes")

    # the kinds of more than one chunk, so at most a row for each chunk's worth of vectors
    most = F.greatest(F.lit(256), F.floor(F.lit(CHUNK) / (4 * F.col("size"))))
    large, held = [], 0
    for row in nodes.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > most).collect():
        large.append(Row(kind=row.kind, parts=-(-row.k // chunk_rows(row.size)), shelf=held // SHELF, bytes=4 * row.k * row.size))
        held += large[-1].bytes

    def vectors(batches):
        for batch in parts(batches):
            for _, size, names, kinds, x in _numbered(batch):
                names, at, copies = np.unique(names, return_index=True, return_counts=True)
                short = x[at].astype(np.float32)
                exact = (short == x[at]).all(1)
                data = [short[i].tobytes() if ok else x[j].tobytes() for i, (j, ok) in enumerate(zip(at, exact, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds[at]), pa.array(np.full(len(at), size)), pa.array(copies), pa.array(data, pa.binary())], ["name", "kind", "size", "copies", "data"])
        tidy()

    def chunk(key, table):
        kind, size, shelf, part = (k.as_py() for k in key)
        names, at, of = np.unique(table.column("name").to_numpy(), return_index=True, return_inverse=True)
        copies = np.bincount(of, table.column("copies").to_numpy()).astype(np.int64)
        data = table.column("data").take(pa.array(at)).to_pylist()
        kept = np.float32 if all(len(b) == 4 * size for b in data) else float
        v = np.vstack([np.frombuffer(b, np.float32 if len(b) == 4 * size else float).astype(kept) for b in data])
        if shelf >= 0:
            row = {"kind": kind, "size": size, "part": part, "names": names.tobytes(), "copies": copies.tobytes(), "data": v.tobytes(), "a": None, "b": None, "n": None, "shelf": shelf}
            return pa.Table.from_pylist([row], schema)
        links, x = Links(threshold), Chunk(names, copies, v)
        links.add(x, part, x, part)
        found = links.found()
        return pa.table([found.column(f.name) if f.name in found.column_names else pa.array(np.full(found.num_rows, shelf, np.int32)) if f.name == "shelf" else pa.nulls(found.num_rows, f.type) for f in schema], schema=schema)

    numbers = {"kind": "long", "size": "long", "part": "int", "names": "binary", "copies": "binary", "data": "binary", "a": "long", "b": "long", "n": "long", "shelf": "int"}
    schema = pa.schema([(k, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for k, t in numbers.items()])
    spots = rows.mapInArrow(vectors, "name long, kind long, size long, copies long, data binary")
    if large:
        spots = spots.join(F.broadcast(spark.createDataFrame(large, "kind long, parts int, shelf int, bytes long")), "kind", "left")
        spots = spots.select("name", "kind", "size", "copies", "data", F.coalesce("shelf", F.lit(-1)).alias("shelf"), F.pmod("name", F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    else:
        spots = spots.withColumns({"shelf": F.lit(-1), "part": F.lit(0)})
    chunks = spots.groupBy("kind", "size", "shelf", "part").applyInArrow(chunk, ", ".join(f"{k} {t}" for k, t in numbers.items()))
    chunks = stored(chunks, "chunks", "shelf")

    def match(batches):
        links, key, x = Links(threshold), None, None

        def side(batch, row, c):
            names, copies, data = (batch.column(f"{f}{c}")[row].as_buffer() for f in ("names", "copies", "data"))
            names = np.frombuffer(names, np.int64)
            cells = len(names) * batch.column("size")[row].as_py()
            return Chunk(names, np.frombuffer(copies, np.int64), np.frombuffer(data, np.float32 if data.size == 4 * cells else float).reshape(len(names), -1))

        for batch in batches:
            for row in range(batch.num_rows):
                kind, i, j = (batch.column(c)[row].as_py() for c in ("kind", "part", "part_b"))
                if key != (kind, i):  # stays for a run of rows
                    key, x = (kind, i), side(batch, row, "")
                links.add(x, key, x if i == j else side(batch, row, "_b"), (kind, j))
        yield from links.found().to_batches(10_000)
        tidy()

    found = chunks.filter("shelf = -1").select("a", "b", "n")
    least = math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1
    for shelf, own in itertools.groupby(large, lambda x: x.shelf):
        x = chunks.filter(F.col("shelf") == shelf).select("kind", "size", "part", "names", "copies", "data")
        x = x.coalesce(max(least, -(-sum(k.bytes for k in own) // SIDE)))
        y = x.select(*[F.col(c).alias(f"{c}_b") for c in x.columns])
        pairs = x.join(y.hint("shuffle_replicate_nl"), (F.col("kind") == F.col("kind_b")) & (F.col("part") <= F.col("part_b"))).drop("kind_b", "size_b")
        found = found.union(pairs.mapInArrow(match, "a long, b long, n long"))
    found = stored(found, "found")

    labels = components(found.filter("b is not null").select("a", "b"))
    sums = found.filter("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    nodes = nodes.select("name", "rep", "copies").join(labels, F.col("name") == F.col("node"), "left").join(sums, F.col("name") == F.col("of"), "left")
    nodes = stored(nodes.select("name", "rep", F.coalesce("label", "name").alias("label"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")).filter("links > 0"), "linked")
    smallest = nodes.groupBy("label").agg(F.min("rep").alias("component"))
    by_name = stored(nodes.join(smallest, "label").select("name", "links", "component"), "by_name")
    out = named.select("vec_id", "name").join(by_name, "name", "left")
    whole = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), (F.col("vec_id") == whole).alias("kept"))
