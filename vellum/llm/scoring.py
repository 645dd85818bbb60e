"""Context-tree weighting over bytes (operator 1), beside a word unigram base score.

The model codes each text as lower-cased UTF-8 bytes and one end mark (0xFF, no UTF-8 byte). A byte is eight
binary decisions; each decision is predicted in the contexts of the 0 to `depth` preceding bytes by
Krichevsky-Trofimov estimates, mixed over all depths by context-tree weighting:
P_w(node) = 1/2 P_e(node) + 1/2 prod P_w(children), P_w = P_e at the full depth. The counts are of all training
documents; a text is scored by the trained tree as it stands, so its probability doesn't depend on other texts.

As a Spark job: partitions sum (context, byte) and word counts, which are shuffled by key; the tree is weighted
bottom-up in groups that share the two nearest context bytes, at most 65,536 x 255 of whose roots reach the driver
(a fixed bound) for the top two levels, and is read top-down into a table of code lengths. The table is broadcast
in shards of at most `table_rows` rows, by context, with one scoring pass for each shard, and the parts of a text's
score are summed: exact at any size of the tree. Words with at least 2**-20 of all tokens (so at most 2**20 of
them) are broadcast; all others are joined by their names.

Edge cases: null and empty texts are one end token; null ids count as held out; with no training document every
bit has probability 1/2; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .textops import LOWER, slices, small_batches, stored, U, word_hashes, words

END = 255
HOT_SHARE = 1 << 20
GROUPS = 64


def contexts(buf: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every byte and end mark; code: nearest context byte highest, the coded byte lowest."""
    rows = len(offs) - 1
    sizes = np.diff(offs)
    block = offs[:-1] + np.arange(rows) * (depth + 1)
    line = np.full(len(buf) + rows * (depth + 1), END, np.uint8)
    real = np.ones(len(line), bool)
    for d in range(depth):
        real[block + d] = False
    row_of = np.repeat(np.arange(rows), sizes)
    line[np.arange(len(buf)) + row_of * (depth + 1) + depth] = LOWER[buf]
    pos = np.flatnonzero(real)
    code = np.zeros(len(pos), U)
    for d in range(1, depth + 1):
        code = (code << U(8)) | line[pos - d]
    return (code << U(8)) | line[pos], np.repeat(np.arange(rows), sizes + 1)


def _log_gamma(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lgamma(n + 1/2) and lgamma(n + 1), by Stirling's series past a table."""

    def at(x):
        small = np.minimum(x, 30.0)
        up = np.zeros_like(x)
        y = x.copy()
        for _ in range(8):
            low = y < 10
            up = np.where(low, up + np.log(np.where(low, y, 1)), up)
            y = np.where(low, y + 1, y)
        del small
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up

    x = n.astype(float)
    return at(x + 0.5), at(x + 1.0)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0)[0] + _log_gamma(n1)[0] - _log_gamma(n0 + n1)[1] - math.log(math.pi)


def _sum(keys, *values):
    u, inverse = np.unique(keys, return_inverse=True)
    return (u, *[np.bincount(inverse, v, len(u)) for v in values])


def leaves(codes: np.ndarray, counts: np.ndarray, depth: int):
    """Counts of zeros and ones of the binary nodes at full depth; a node's key: context, then 1 and the bits so far."""
    keys, zeros, ones = [], [], []
    context, byte = codes >> U(8), codes & U(255)
    for j in range(8):
        bit = ((byte >> U(7 - j)) & U(1)).astype(bool)
        keys.append((context << U(8)) | U(1 << j) | (byte >> U(8 - j)))
        zeros.append(np.where(bit, 0, counts))
        ones.append(np.where(bit, counts, 0))
    return _sum(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def up(nodes, log_pw):
    """The parents of nodes one context byte shorter: key, zeros, ones, log P_w and the weight of stopping."""
    keys, zeros, ones = nodes
    parent = ((keys >> U(16)) << U(8)) | (keys & U(255))
    k, n0, n1, below = _sum(parent, zeros, ones, log_pw)
    own = kt(n0, n1)
    whole = np.logaddexp(own, below) - math.log(2)
    return (k, n0, n1), whole, np.exp(own - math.log(2) - whole)


def down(nodes, stop, above):
    """For nodes: (weighted estimate so far, weight left) given those of their parents (keys, mix, left)."""
    keys, zeros, ones = nodes
    if above is None:
        mix, left = np.zeros(len(keys)), np.ones(len(keys))
    else:
        parent = ((keys >> U(16)) << U(8)) | (keys & U(255))
        i = np.searchsorted(above[0], parent)
        mix, left = above[1][i], above[2][i]
    return keys, mix + left * stop * (ones + 0.5) / (zeros + ones + 1), left * (1 - stop)


def tree(codes, counts, depth: int, lowest: int):
    """Levels depth..lowest: {level: (nodes, weight of stopping)}, and log P_w at the lowest."""
    nodes = leaves(codes, counts, depth)
    log_pw, out = kt(nodes[1], nodes[2]), {}
    out[depth] = (nodes, np.ones(len(nodes[0])))
    for level in range(depth - 1, lowest - 1, -1):
        nodes, log_pw, stop = up(nodes, log_pw)
        out[level] = (nodes, stop)
    return out, log_pw


class Table:
    """Code lengths of seen (context, byte) pairs, and the last seen node's estimate for all others."""

    def __init__(self, depth: int, kinds, keys, values):
        self.depth = depth
        self.levels = {}
        for level in range(depth + 2):  # depth + 1: whole bytes
            of = kinds == level
            order = np.argsort(keys[of])
            self.levels[level] = keys[of][order], values[of][order]

    def _find(self, level, keys):
        known, values = self.levels[level]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[i] == keys, values[i]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        seen, out = self._find(self.depth + 1, codes)
        rest = codes[~seen]
        total = np.zeros(len(rest))
        for j in range(8):
            node = U(1 << j) | ((rest & U(255)) >> U(8 - j))
            p, open_ = np.full(len(rest), 0.5), np.ones(len(rest), bool)
            for level in range(self.depth, -1, -1):
                context = (rest >> U(8)) >> U(8 * (self.depth - level)) if level else np.zeros(len(rest), U)
                hit, value = self._find(level, (context << U(8)) | node)
                p = np.where(open_ & hit, value, p)
                open_ &= ~hit
            total += np.log10(np.where((rest >> U(7 - j)) & U(1), p, 1 - p))
        out = out.copy()
        out[~seen] = total
        return out


def rows_of(levels: dict, above, codes, depth: int, lowest: int):
    """(kind, key, value) rows of the table for levels from `lowest`, given the level over it."""
    kinds, keys, values, estimate = [], [], [], None
    for level in range(lowest, depth + 1):
        nodes, stop = levels[level]
        above = down(nodes, stop, above)
        estimate = above[1] + above[2] * 0.5
        kinds.append(np.full(len(nodes[0]), level, np.int8))
        keys.append(above[0])
        values.append(estimate)
    if depth >= lowest and codes is not None:
        length = np.zeros(len(codes))
        for j in range(8):
            i = np.searchsorted(keys[-1], ((codes >> U(8)) << U(8)) | U(1 << j) | ((codes & U(255)) >> U(8 - j)))
            p = values[-1][i]
            length += np.log10(np.where((codes >> U(7 - j)) & U(1), p, 1 - p))
        kinds.append(np.full(len(codes), depth + 1, np.int8))
        keys.append(codes)
        values.append(length)
    return np.concatenate(kinds), np.concatenate(keys), np.concatenate(values), above


def score(df, depth: int = 4, held_out=None, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 12_000_000):
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    held_out: a boolean Column; by default crc32 of the id's text modulo 10 is 0.
    """
    if not 2 <= depth <= 4:
        raise ValueError("depth must be 2 to 4")
    apart = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0 if held_out is None else held_out, F.lit(True))
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), apart.alias("held_out"), F.monotonically_increasing_id().alias("uid"))
    spark = df.sparkSession

    def count(batches):
        held: dict[int, list] = {0: [], 1: []}
        many = 0

        def merged(kind):
            keys, n = _sum(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))
            held[kind] = [(keys, n)]
            return len(keys)

        def emit():
            for kind in (0, 1):
                if held[kind]:
                    merged(kind)
                    keys, n = held[kind][0]
                    held[kind] = []
                    for at in range(0, len(keys), 100_000):
                        part = keys[at : at + 100_000].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[at : at + 100_000].astype(np.int64))], ["kind", "key", "n"])

        size = 0
        for batch in batches:
            many += batch.num_rows
            for _, buf, offs in slices(batch.column("text")):
                starts, ends, _ = words(buf, offs)
                for kind, keys in ((0, word_hashes(LOWER[buf], starts, ends)), (1, contexts(buf, offs, depth)[0])):
                    u, n = np.unique(keys, return_counts=True)
                    held[kind].append((u, n))
                    size += len(u)
                if size > 3_000_000:
                    size = merged(0) + merged(1)
                    if size > 1_500_000:
                        yield from emit()
                        size = 0
        yield from emit()
        if many:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0]), pa.array([many])], ["kind", "key", "n"])

    counts = docs.filter(~F.col("held_out")).select("text").mapInArrow(count, "kind byte, key long, n long")
    counts = stored(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    totals = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    texts = totals[2].n if 2 in totals else 0
    n_all = (totals[0].n if 0 in totals else 0) + texts
    v_all = (totals[0].v if 0 in totals else 0) + bool(texts)
    scale = n_all + 0.1 * (v_all + 1)
    log_p = lambda c: np.log10((c + 0.1) / scale)
    hot = counts.filter((F.col("kind") == 0) & (F.col("n") * HOT_SHARE >= n_all)).select("key", "n").toArrow()
    order = np.argsort(k := hot.column("key").to_numpy().astype(U))
    hot_words = spark.sparkContext.broadcast((k[order], hot.column("n").to_numpy()[order]))
    end_log = float(log_p(np.array([float(texts)]))[0])

    grams = counts.filter("kind = 1").select("key", "n", F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8 * depth - 8)), F.lit(GROUPS)).alias("g"))

    def roots(key, table):
        levels, log_pw = tree(table.column("key").to_numpy().astype(U), table.column("n").to_numpy(), depth, 2)
        k, n0, n1 = levels[2][0]
        return pa.table([pa.array(k.astype(np.int64)), pa.array(n0), pa.array(n1), pa.array(log_pw)], names=["key", "n0", "n1", "w"])

    top = grams.groupBy("g").applyInArrow(roots, "key long, n0 double, n1 double, w double").toArrow()
    k2 = top.column("key").to_numpy().astype(U)
    kinds, keys, values = np.zeros(0, np.int8), np.zeros(0, U), np.zeros(0)
    near = None
    if len(k2):
        o = np.argsort(k2)
        nodes2 = (k2[o], top.column("n0").to_numpy()[o], top.column("n1").to_numpy()[o])
        nodes1, w1, stop1 = up(nodes2, top.column("w").to_numpy()[o])
        nodes0, _, stop0 = up(nodes1, w1)
        kinds, keys, values, near = rows_of({0: (nodes0, stop0), 1: (nodes1, stop1)}, None, None, 1, 0)
    over = spark.sparkContext.broadcast(near)

    def codes_of(key, table):
        codes = table.column("key").to_numpy().astype(U)
        levels, _ = tree(codes, table.column("n").to_numpy(), depth, 2)
        k, x, v, _ = rows_of(levels, over.value, codes, depth, 2)
        g = np.full(len(k), key[0].as_py(), np.int32)
        return pa.table([pa.array(k), pa.array(x.astype(np.int64)), pa.array(v.astype(np.float32)), pa.array(g)], names=["kind", "key", "value", "g"])

    table = stored(grams.groupBy("g").applyInArrow(codes_of, "kind byte, key long, value float, g int"), "lengths")
    shards = max(1, -(-table.count() // table_rows))
    own_group = F.pmod(F.xxhash64("pair"), F.lit(GROUPS))
    pairs = spark.range(1 << 16).select(F.col("id").alias("pair")).select("pair", own_group.alias("g")) if shards > 1 else None

    parts = None
    for shard in range(shards):
        mine = table if shards == 1 else table.filter(F.col("g") % shards == shard)
        got = mine.select("kind", "key", "value").toArrow()
        model = Table(depth, np.concatenate([kinds, got.column("kind").to_numpy()]), np.concatenate([keys, got.column("key").to_numpy().astype(U)]), np.concatenate([values, got.column("value").to_numpy().astype(float)]))
        del got
        sent = spark.sparkContext.broadcast(model)
        only = None
        if pairs is not None:
            only = np.zeros(1 << 16, bool)
            only[[r.pair for r in pairs.filter(F.col("g") % shards == shard).collect()]] = True
        part = docs.mapInArrow(_scorer(sent, hot_words, scale, end_log, texts, depth, shard == 0, only), _SCORED)
        parts = part if parts is None else parts.union(part)

    known = counts.filter("kind = 0").select(F.col("key").alias("name"), F.col("n").alias("c"))
    rare = parts.join(known, "name", "left")
    c = F.when(F.col("whole"), None).otherwise(F.coalesce("c", F.lit(0)))
    rare_log = F.when(F.col("whole"), F.lit(0.0)).otherwise(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(scale)))
    out = rare.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        (F.sum("base") + F.sum(rare_log)).alias("base_score"), F.sum("score").alias("score"), F.max("n_bytes").alias("n_bytes"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


_SCORED = "uid long, doc_id long, held_out boolean, whole boolean, name long, times long, n_tokens long, n_known long, base double, score double, n_bytes long"


def _scorer(sent, hot_words, scale, end_log, texts, depth, with_words, only):
    def run(batches):
        model = sent.value
        hot, hot_n = hot_words.value
        hot_log = np.log10((hot_n + 0.1) / scale)
        for batch in batches:
            for at, buf, offs in slices(batch.column("text")):
                rows = len(offs) - 1
                code, row = contexts(buf, offs, depth)
                if only is not None:
                    mine = only[(code >> U(8 * (depth - 1))).astype(np.int64)]
                    code, row = code[mine], row[mine]
                packed = np.sort((code << U(24)) | row.astype(U))
                cut = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
                times = np.diff(np.r_[cut, len(packed)])
                code, row = packed[cut] >> U(24), (packed[cut] & U(0xFFFFFF)).astype(np.int64)
                new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else cut
                per = np.repeat(model.log10(code[new]), np.diff(np.r_[new, len(code)]))
                total = np.bincount(row, per * times, rows)
                ids = batch.column("doc_id").slice(at, rows)
                out = batch.column("held_out").slice(at, rows)
                uid = batch.column("uid").slice(at, rows).to_numpy()
                zero = np.zeros(rows)
                n_tokens, n_known, base = zero, zero, zero
                names, times, owner = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if with_words:
                    starts, ends, of = words(buf, offs)
                    wh = word_hashes(LOWER[buf], starts, ends)
                    i = np.minimum(np.searchsorted(hot, wh), max(0, len(hot) - 1))
                    is_hot = hot[i] == wh if len(hot) else np.zeros(len(wh), bool)
                    n_tokens = np.bincount(of, minlength=rows) + 1
                    n_known = np.bincount(of, is_hot, rows) + (texts > 0)
                    base = np.bincount(of[is_hot], hot_log[i[is_hot]], rows) + end_log
                    names, owner = wh[~is_hot], of[~is_hot]
                    o = np.lexsort((owner, names))
                    names, owner = names[o], owner[o]
                    cut = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])]) if len(names) else np.zeros(0, np.int64)
                    times = np.diff(np.r_[cut, len(names)])
                    names, owner = names[cut], owner[cut]
                m = len(names)
                spread = (uid.astype(U) * U(0x9E3779B97F4A7C15)).astype(np.int64)
                both = lambda x, kind: pa.concat_arrays([pa.array(np.asarray(x), kind), pa.nulls(m, kind)])
                filled = lambda x, kind: pa.array(np.concatenate([x, np.zeros(m)]), pa.float64()).cast(kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([uid, uid[owner]])), pa.concat_arrays([ids, pa.nulls(m, pa.int64())]), pa.concat_arrays([out, pa.nulls(m, pa.bool_())]),
                    pa.array(np.arange(rows + m) < rows), pa.array(np.concatenate([spread, names.astype(np.int64)])), pa.array(np.concatenate([np.zeros(rows, np.int64), times])),
                    both(n_tokens, pa.int64()) if with_words else pa.nulls(rows + m, pa.int64()), filled(n_known, pa.int64()), filled(base, pa.float64()), filled(total, pa.float64()), both(np.diff(offs), pa.int64()),
                ], ["uid", "doc_id", "held_out", "whole", "name", "times", "n_tokens", "n_known", "base", "score", "n_bytes"])

    return run
