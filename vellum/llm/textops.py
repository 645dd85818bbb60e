"""Vectorised word and hash primitives over Arrow string columns, and shared-folder tables.

Every function works on a slice of whole texts: a flat UTF-8 byte buffer plus row offsets. Null
texts count as empty. Names are 64-bit sums of values times random multipliers, finalised by a mixer (multilinear hashing);
they are the same in every process. Two different words or windows share a name with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = np.random.Generator(np.random.PCG64(20240917))
_DIGITS = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
_LEFT, _RIGHT, _SIZE = (U(x) for x in _SEED.integers(1, 2**63, 3, dtype=np.uint64) * U(2) + U(1))
_places = {"odd": np.zeros(0, U)}
SLICE_BYTES = 1 << 19
#: Folders that stored() wrote in this process, the newest last.
STORED: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _multipliers(n: int) -> np.ndarray:
    """A random odd multiplier for each of n places, kept between calls."""
    if len(_places["odd"]) < n:
        _places["odd"] = mix(np.arange(max(n, 1 << 12), dtype=U) * U(0x9E3779B97F4A7C15) + U(77)) | U(1)
    return _places["odd"][:n]


def sequence_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit name for each run values[start:end]: a sum of values times multipliers that are random for each place of
    the run, so that no structure of the values makes different runs collide. Runs stand in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, U)
    sizes = ends - starts
    first = int(starts[0])
    place = np.arange(first, len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    most = int(sizes.max())
    sums = np.zeros(len(values) - first + 1, U)
    np.cumsum(values[first:] * _multipliers(most)[np.minimum(place, most - 1)], out=sums[1:])
    return mix(sums[ends - first] - sums[starts - first] + sizes.astype(U) * _SIZE)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """(first row, buffer, offsets) of runs of whole texts of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACES):
    """Starts, ends and row numbers of the maximal runs of bytes that aren't separators."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[buf]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = np.unique(offs[(offs > 0) & (offs < n)])
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit name for each word; equal words have equal names."""
    return sequence_names(_DIGITS[buf], starts, ends)


def window_hashes(names: np.ndarray, n: int) -> np.ndarray:
    """Names of the n consecutive words that start at each place; places past the end are left out. Names of windows of
    1, 2, 4, ... words are put together by two, and those of n's binary digits make up a window."""
    if len(names) < n:
        return np.zeros(0, U)
    m, out, at, width, rest = len(names) - n + 1, None, 0, 1, n
    while True:
        if rest & 1:
            part = names[at : at + m]
            out = part if out is None else mix(out * _LEFT + part * _RIGHT)
            at += width
        rest >>= 1
        if not rest:
            return mix(out + U(n * int(_SIZE) % 2**64))
        names = mix(names[:-width] * _LEFT + names[width:] * _RIGHT)
        width *= 2


def same_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether the window of n words from each place stays in one row."""
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle names of each row; fewer words: the whole sequence as one; none: empty."""
    starts, ends, rows = words(buf, offs)
    names = word_hashes(buf, starts, ends)
    grams = window_hashes(names, n)
    bounds = np.searchsorted(rows, np.arange(len(offs)))
    out = []
    for i in range(len(offs) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(names[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def tokenizer_path(kind: str = "json") -> str:
    """The vocabulary file of the installed public tokenizer, or its ranks; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors must share; where it is unset and Spark runs in one
    process (as in tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tidy() -> None:
    """Gives freed memory back to the system at the end of a task: workers outlive their tasks, and what they hold counts
    against the executor while later stages run in the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of texts, whose default of 10,000 rows is tens of MB in the JVM and again in Python. A session that
    has its own setting keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def stored(df, name: str, by: str | None = None):
    """The rows of df as a Parquet table in the shared folder: cuts the lineage, outlives executors. by: a folder for each value.
    The shuffle files of the write go with its end, not when the driver happens to collect its garbage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        conf.set(CLEANUP, before)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark, paths) -> None:
    """Deletes folders that stored() wrote."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables) -> None:
    """Deletes tables that stored() made and nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, {f.rpartition("/")[0] for f in table.inputFiles()})


def join_roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Merges the trees of p and q in root, where each node points at the smallest of its tree."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(top := root[root], root):
            root[:] = top


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links a-b do, at most one for each node."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    join_roots(root, *np.split(places, 2))
    tree = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[tree]], nodes[tree]


FOREST = 500_000


def _forest(batches):
    """Links that connect what the given ones do, at most one for each node of every FOREST links."""

    def emitted(a, b):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in thinned(np.concatenate(a), np.concatenate(b))], ["x", "y"])

    a, b = [], []
    for batch in batches:
        a.append(batch.column("x").to_numpy())
        b.append(batch.column("y").to_numpy())
        if sum(map(len, a)) >= FOREST:
            yield emitted(a, b)
            a, b = [], []
    if a:
        yield emitted(a, b)
    tidy()


def components(edges, low: str = "a", high: str = "b"):
    """(node, label) of every node of an edge table: label is the smallest node that links reach.

    Slices of FOREST links are first thinned to a link for each node at most. Then labels flow along links and jump to
    their own label, until nothing changes; each round is a stored table, and the last round's tables go. Links to a hub
    are summed by node after the join. No edges: an empty table.
    """
    from pyspark.sql import functions as F

    links = stored(edges.select(F.col(low).cast("long").alias("x"), F.col(high).cast("long").alias("y")), "links")
    both = links.coalesce(-(-links.count() // FOREST) or 1).mapInArrow(_forest, "x long, y long")
    both = stored(both.union(both.select(F.col("y"), F.col("x"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("label")), "labels")
    while True:
        around = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(around, labels.node == around.x).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("top"))
        new = step.join(jump, step.label == jump["at"], "left").select("node", F.coalesce("top", "label").alias("label"), "old")
        new = stored(new, "labels")
        dropped(labels, step)
        if new.filter("label <> old").isEmpty():
            dropped(both, links)
            return new.select("node", "label")
        labels = new.select("node", "label")
