"""Document fingerprints by locally consistent parsing (operator 8).

A text is parsed bottom-up. At each level runs of equal names are named as one; deterministic coin tossing turns the
names into labels below 8 that differ between neighbours; phrases start at local maxima of the labels and are named
by their content. Where a phrase starts depends on a bounded number of neighbours only, so equal substrings get
equal interior phrases at every level, whatever their offsets. The fingerprint holds, for levels 1 to 3, the
smallest of the hashed phrase names; likeness estimates the Jaccard index of the phrase sets at the highest level
at which both texts have enough phrases.

Edge cases: null and empty texts have the empty fingerprint; two empty fingerprints are alike (1), one is not (0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .textops import _DIGITS, mix, sequence_names, small_batches, tidy, U

SIZES = (24, 24, 64)
ENOUGH = 8
GROUP_BYTES = 4_000_000
LAST = 2**62
_LOW = np.array([8] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit place in which a label differs from its left neighbour, and the bit there."""
    out = np.empty_like(labels, np.uint8)
    if labels.dtype == np.uint8:
        place = _LOW[labels[1:] ^ labels[:-1]] & 7
        out[1:] = 2 * place + ((labels[1:] >> place) & 1)
        out[:1] = labels[:1] & 1
    else:
        differ = labels[1:] ^ labels[:-1]
        _, e = np.frexp((differ & (~differ + U(1))).astype(np.float64))
        place = np.maximum(e - 1, 0).astype(U)
        out[1:] = (U(2) * place + ((labels[1:] >> place) & U(1))).astype(np.uint8)
        out[:1] = (labels[:1] & U(1)).astype(np.uint8)
    out[first] = (labels[first] & labels.dtype.type(1)).astype(np.uint8)
    return out


def parse(names: np.ndarray, labels: np.ndarray, rows: np.ndarray):
    """Names and rows of the next level's phrases. labels: any injective labels of the names."""
    n = len(names)
    if not n:
        return names, rows
    new = np.r_[True, (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])]
    at = np.flatnonzero(new)
    if len(at) < n:
        runs = np.diff(np.r_[at, n])
        long = runs > 1
        names, rows, labels = names[at], rows[at], labels[at]
        names = np.where(long, mix(names + mix(runs.astype(U))), names)
        n = len(at)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    for _ in range(3 if labels.dtype == np.uint8 else 4):
        labels = _toss(labels, first)
    cut = np.zeros(n, bool)
    if n > 2:
        cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    cut[first] = True
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], n]
    return sequence_names(names, starts, ends), rows[starts]


def fingerprints(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """For each text, the smallest 32-bit phrase hashes of each level."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.repeat(np.arange(len(texts)), sizes)
    names, labels, levels = _DIGITS[buf], buf, []
    for size in SIZES:
        names, rows = parse(names, labels, rows)
        labels = names
        small = (mix(names + U(size)) >> U(32)).astype(np.uint32)
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        levels.append([np.unique(small[bounds[i] : bounds[i + 1]])[:size] for i in range(len(texts))])
    return list(zip(*levels, strict=True)) if texts else []


def spell(fingerprint) -> str:
    return ".".join(x.astype(">u4").tobytes().hex() for x in fingerprint) if any(len(x) for x in fingerprint) else ""


def likeness(a, b) -> float:
    """Estimated Jaccard index of two fingerprints' phrase sets, 0 to 1."""
    for level in (2, 1, 0):
        x, y = a[level], b[level]
        if min(len(x), len(y)) >= ENOUGH or level == 0:
            k = SIZES[level]
            both = np.union1d(x, y)[:k]
            if not len(both):
                return 1.0
            return float(np.isin(both, x).astype(int) @ np.isin(both, y).astype(int)) / len(both)
    return 0.0


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(df, id_col: str = "doc_id", text_col: str = "text"):
    """Fingerprints of every document and of its edited text, whose second half is the next document's beginning.

    The next document is found without sorting the corpus in one place: ids are cut into ranges at quantiles, and the
    first document of each range is also sent to the range before it (a bounded number of ids reaches the driver).
    Texts travel compressed. Rows with equal ids follow each other by text; null ids come last.
    """
    small_batches(df.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    docs = df.select(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = df.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    at = [(i + 1) / parts for i in range(parts - 1)]
    cuts = docs.agg(F.percentile_approx("id", at, 20 * parts)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket(batches):
        for batch in batches:
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.searchsorted(cuts, ids.to_numpy()).astype(np.int64))], ["id", "part"])

    firsts = dict(tuple(r) for r in docs.select("id").mapInArrow(bucket, "id long, part long").groupBy("part").agg(F.min("id")).collect())
    order = sorted(firsts)
    goes_to = {firsts[p]: order[k - 1] for k, p in enumerate(order)}

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column("id").to_numpy()
                data = [squeeze(t.encode()) for t in part.column("text").to_pylist()]
                guests = [i for i, x in enumerate(ids) if x in goes_to]
                where = np.r_[np.searchsorted(cuts, ids), [goes_to[ids[i]] for i in guests]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.r_[ids, ids[guests]].astype(np.int64)), pa.array(np.arange(len(where)) >= len(ids)), pa.array(data + [data[i] for i in guests], pa.binary())], ["part", "id", "guest", "data"])

    def name(key, table):
        plain = zstandard.ZstdDecompressor().decompress
        texts = [plain(b).decode() for b in table.column("data").to_pylist()]
        ids = table.column("id").to_pylist()
        guest = table.column("guest").to_pylist()
        own = sorted((ids[i], texts[i]) for i in range(len(ids)) if not guest[i])
        come = min(((ids[i], texts[i]) for i in range(len(ids)) if guest[i]), default=None)
        if not own:
            return pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")})
        line = own + [come or own[0]]
        changed, hashes, chars = [], [], []
        for (_, t), (_, after) in zip(line[:-1], line[1:], strict=True):
            k = len(t) // 2
            e = (t[: len(t) - k] + after[:k]).encode()
            changed.append(e)
            hashes.append(hashlib.sha256(e).hexdigest())
            chars.append(len(t))
        prints, edits = [], []
        for out, texts in ((prints, [t.encode() for _, t in line]), (edits, changed)):
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= 1 << 20:
                    size += len(texts[hi])
                    hi += 1
                out += fingerprints(texts[lo:hi])
                lo = hi
        n = len(own)
        return pa.table({
            "doc_id": pa.array([None if i == LAST else i for i, _ in own], pa.int64()), "n_chars": pa.array(chars, pa.int64()), "edited_sha256": hashes,
            "fingerprint": [spell(x) for x in prints[:n]], "edited_fingerprint": [spell(x) for x in edits],
            "near_edited": pa.array([likeness(x, y) for x, y in zip(prints[:n], edits, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(x, y) for x, y in zip(prints[:n], prints[1:], strict=True)], pa.float64()),
        })

    return docs.mapInArrow(deal, "part long, id long, guest boolean, data binary").groupBy("part").applyInArrow(name, SCHEMA)
