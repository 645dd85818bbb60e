"""Substring dedup with repeated-phrase automata (operator 2).

A passage of `window` consecutive words goes where the same words start in a document with a smaller id.

1. Documents are dealt into shards of bounded size. Each shard names the least 8-word phrase of each of its
   windows (equal windows have the same one); phrases seen in two documents or more recur.
2. Each shard compiles Aho-Corasick automata of the recurring phrases that it has, over words (a letter of 16 bits
   for each), and streams its documents through them. Around every occurrence, the windows whose least phrase it is are
   named in full; the smallest id of each name, over all shards, is found by a window function. What travels is one
   row per name and shard. Windows that start in two documents or more are confirmed.
3. Each shard streams its documents through its automata again; the windows located that way whose name is confirmed
   with a smaller id are removed. Nothing but a hit of an automaton leads to a removal. Each document is
   streamed twice, at any size of the corpus, and only through automata of phrases that its shard has.

Windows are told apart by 64-bit names. A phrase's or a window's rows that meet in one task are one a shard at most.
Edge cases: null and empty texts have no words; null ids count as larger than all others; rows with equal ids never
remove each other's words; very long texts are one row of their shard and are parsed in whole; columns of df that aren't
in `carry` don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .textops import same_row, slices, tidy, window_hashes, word_hashes, words

PHRASE, SHARD_BYTES, MOST = 8, 2_000_000, 20_000
LAST = 2**62


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _parsed(table, size):
    """For each slice: first row, buffer, offsets, word starts, ends, rows, names and the starts of windows in one row."""
    for at, buf, offs in slices(table.column("text")):
        starts, ends, rows = words(buf, offs)
        names = word_hashes(buf, starts, ends)
        valid = np.flatnonzero(same_row(rows, size))
        yield at, buf, offs, starts, ends, rows, names, valid


def letters(names: np.ndarray) -> np.ndarray:
    """16 bits of each word's name."""
    return (names >> np.uint64(48)).astype("<u2")


def spelled(codes: np.ndarray) -> str:
    """Letters as a string of one character each."""
    wide = codes.astype("<u4") + np.uint32(1)
    wide[wide >= 0xD800] += np.uint32(0x800)
    return wide.tobytes().decode("utf-32-le")


def least_phrases(names, rows, valid, size: int, phrase: int):
    """(first window, name, letters) of each run of windows of a row that have the same least phrase."""
    width = size - phrase + 1
    every = window_hashes(names, phrase)
    least = sliding_min(every, width)[valid]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (rows[valid[1:]] != rows[valid[:-1]])])
    codes, out = letters(names), []
    for at in range(0, len(new), 20_000):
        first = valid[new[at : at + 20_000]]
        place = first + (every[first[:, None] + np.arange(width)] == least[new[at : at + 20_000], None]).argmax(1)
        out.append(codes[place[:, None] + np.arange(phrase)])
    return valid[new], least[new], np.concatenate(out)


def automata(keys, phrase: int) -> list:
    """Aho-Corasick automata of at most MOST phrases each."""
    import ahocorasick

    out, keys = [], sorted(set(keys))
    for at in range(0, len(keys), MOST):
        line = spelled(np.frombuffer(b"".join(keys[at : at + MOST]), "<u2"))
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in range(0, len(line), phrase):
            machine.add_word(line[k : k + phrase])
        machine.make_automaton()
        out.append(machine)
    return out


def located(machines, names, valid, size: int, phrase: int) -> np.ndarray:
    """The windows whose least phrase is an occurrence that an automaton found."""
    if not len(valid) or not machines:
        return valid[:0]
    line = spelled(letters(names))
    hit = np.zeros(len(names), bool)
    for machine in machines:
        hit[np.fromiter((end for end, _ in machine.iter(line)), np.int64) - phrase + 1] = True
    if not hit.any():
        return valid[:0]
    every = window_hashes(names, phrase)
    found = np.where(hit[: len(every)], every, np.uint64(2**64 - 1))
    width = size - phrase + 1
    return valid[sliding_min(every, width)[valid] == sliding_min(found, width)[valid]]


def _ranges(names, docs):
    """Where each distinct name stands first, and the smallest and the largest document of each."""
    order = np.argsort(names, kind="stable")
    names, docs = names[order], docs[order]
    if not len(names):
        return order, docs, docs
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    return order[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)


def _ids(table):
    return table.column("id").to_numpy()


def text_of(buf, offs, starts, ends, rows, keep):
    """The kept words of each row, joined by one space: a flat buffer and its offsets."""
    mask = np.zeros(len(buf) + 1, bool)
    edge = np.zeros(len(buf) + 1, np.int32)
    kept = np.flatnonzero(keep)
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept], -1)
    mask[:] = np.cumsum(edge) > 0
    inner = kept[:-1][rows[kept[:-1]] == rows[kept[1:]]] if len(kept) else kept
    out = np.append(buf, np.uint8(32))
    out[ends[inner]] = 32
    mask[ends[inner]] = True
    sizes = np.concatenate([[0], np.cumsum(mask[:-1])])
    return out[:-1][mask[:-1]], sizes[offs]


def remove_repeats(df, window: int = 50, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()):
    """One row per document: id_col, kept (text of the words left, joined by one space), n_words, n_removed, and `carry`.

    window: words of a passage. Phrases have at most `phrase` words (fewer where the window is short).
    """
    size = window
    phrase = min(phrase, size)
    key = F.col(id_col).cast("long")
    docs = df.select(key.alias("given"), F.coalesce(key, F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * parts, -(-total // SHARD_BYTES))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    def table_of(keys, names, lo, hi, shard):
        return pa.table([pa.array(keys, pa.binary()), pa.array(names, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(np.full(len(lo), shard, np.int64))], names=["key", "name", "lo", "hi", "shard"])

    def candidates(key, table):
        ids, names, codes, docs_of = _ids(table), [], [], []
        for at, _, _, _, _, rows, wh, valid in _parsed(table, size):
            if len(valid):
                first, least, phrases = least_phrases(wh, rows, valid, size, phrase)
                names.append(least)
                codes.append(phrases)
                docs_of.append(ids[at + rows[first]])
        if not names:
            return table_of([], [], [], [], 0)
        which, lo, hi = _ranges(np.concatenate(names), np.concatenate(docs_of))
        data, width = np.concatenate(codes)[which].tobytes(), 2 * phrase
        tidy()
        return table_of([data[i : i + width] for i in range(0, len(data), width)], np.zeros(len(lo), np.int64), lo, hi, key[0].as_py())

    found = "key binary, name long, lo long, hi long, shard long"
    by = lambda c: Window.partitionBy(c)
    seen = docs.groupBy("shard").applyInArrow(candidates, found)
    seen = seen.withColumn("first", F.min("lo").over(by("key"))).withColumn("last", F.max("hi").over(by("key"))).filter("first < last").select("key", "shard")

    def confirm(key, table, wanted):
        ids, names, docs_of = _ids(table) if table.num_rows else (), [], []
        machines = automata(wanted.column("key").to_pylist(), phrase) if table.num_rows and wanted.num_rows else []
        for at, _, _, _, _, rows, wh, valid in _parsed(table, size) if machines else ():
            places = located(machines, wh, valid, size, phrase)
            if len(places):
                names.append(window_hashes(wh, size)[places])
                docs_of.append(ids[at + rows[places]])
        if not names:
            return table_of([], [], [], [], 0)
        every, keys = np.concatenate(names), wanted.column("key").to_pylist()
        which, lo, hi = _ranges(every, np.concatenate(docs_of))
        tidy()
        # the phrases go along with the windows, under names that only spread them
        spread = np.frombuffer(b"".join(keys), "<u2").reshape(len(keys), -1)[:, :4].copy() if phrase >= 4 else np.tile(np.arange(len(keys), dtype="<u2")[:, None], 4)
        n, m = len(keys), len(which)
        return table_of(keys + [None] * m, np.r_[spread.view("<i8").ravel(), every[which].astype(np.int64)], np.r_[np.full(n, LAST + 1), lo], np.r_[np.zeros(n, np.int64), hi], key[0].as_py())

    again = docs.groupBy("shard").cogroup(seen.groupBy("shard")).applyInArrow(confirm, found)
    told = again.withColumn("first", F.min("lo").over(by("name"))).filter("key is not null or first < hi").select("key", "name", "first", "shard")

    extra = [f for f in docs.schema.fields if f.name.startswith("carry_")]
    schema = "given long, kept string, n_words long, n_removed long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)

    def remove(key, table, told):
        ids = _ids(table) if table.num_rows else np.zeros(0, np.int64)
        confirmed = told.filter(told.column("key").is_null()) if told.num_rows else told
        machines = automata(told.column("key").drop_null().to_pylist(), phrase) if confirmed.num_rows else []
        known, first = confirmed.column("name").to_numpy().astype(np.uint64), confirmed.column("first").to_numpy()
        order = np.argsort(known)
        known, first = known[order], first[order]
        texts, counts, gone_of = [], [], []
        for at, buf, offs, starts, ends, rows, wh, valid in _parsed(table, size) if table.num_rows else ():
            places = located(machines, wh, valid, size, phrase)
            if len(places):
                full = window_hashes(wh, size)[places]
                i = np.minimum(np.searchsorted(known, full), len(known) - 1)
                places = places[(known[i] == full) & (first[i] < ids[at + rows[places]])]
            cover = np.zeros(len(wh) + size + 1, np.int32)
            cover[places] += 1
            cover[places + size] -= 1
            gone = np.cumsum(cover)[: len(wh)] > 0
            data, sizes = text_of(buf, offs, starts, ends, rows, ~gone)
            n = len(offs) - 1
            texts.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string()))
            counts.append(np.bincount(rows, minlength=n))
            gone_of.append(np.bincount(rows, gone, minlength=n).astype(np.int64))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        columns = [table.column("given"), pa.chunked_array(texts, pa.string()), pa.array(cat(counts).astype(np.int64)), pa.array(cat(gone_of))]
        tidy()
        return pa.table(columns + [table.column(f.name) for f in extra], names=["given", "kept", "n_words", "n_removed"] + [f.name for f in extra])

    out = docs.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(remove, schema)
    return out.select(F.col("given").alias(id_col), "kept", "n_words", "n_removed", *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)])
