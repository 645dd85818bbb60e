"""Vector bin packing of token sequences (operator 10).

Each document becomes the ids of a fixed tokenizer plus one end id. Sequences of at most `size` tokens
are filled under three limits at once: tokens, segments and loss-bearing tokens. Work stays inside the
partition that reads the rows: nothing is shuffled, and a bounded number of tokens is held at a time.

Method: a document that meets the limits alone is one item; of a longer one, the tokens without loss are an item
and those that bear loss are cut into items of at most `loss_limit`. An item's demand vector is (tokens, one segment,
loss tokens). A sequence is filled greedily by the item with the largest dot product of its demand and the
sequence's remaining capacity, over items grouped by demand; when nothing fits whole, the item with the largest
product is cut so that the sequence is full. The sequences that are left short at the end of a group are cut into
powers of two, which need no padding.

Edge cases: null and empty texts are one end id; very long texts are cut as often as needed; null ids stay null;
repeated rows are packed again, each alone; an empty table gives an empty result; further columns are ignored, whatever
their names; limits below 1 are an error.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa

from .textops import slices, small_batches, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
GROUP_TOKENS = 2_000_000
SLICE = 1 << 20
#: How this vocabulary's tokenizers cut texts before they merge bytes; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: First bytes of characters that aren't white space: printable ASCII, and leads of ranges without any.
_LEADS = np.zeros(256, bool)
_LEADS[33:127] = _LEADS[0xC3:0xE1] = _LEADS[0xE4:0xF5] = True


def parts_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where parts begin: at the rows' beginnings, at each space between two characters that aren't white space, and before
    and after such a line end. Parts tile the rows. Where a neighbour might be white space beyond ASCII, no part
    begins, which is as right."""
    lines = buf == 10
    mask = lines | (buf == 32)
    mask[:-1] &= _LEADS[buf[1:]]
    before = (buf > 32) & (buf < 127)
    before[1:] |= (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
    before[2:] |= (buf[:-2] >= 0xE4) & (buf[:-2] < 0xF0)
    mask[1:] &= before[:-1]
    full = offs[1:] > offs[:-1]
    mask[offs[1:][full] - 1] = mask[offs[:-1][full]] = False
    mask[1:] |= mask[:-1] & lines[:-1]
    mask[offs[:-1][full]] = True
    return np.flatnonzero(mask)


class Encoder:
    """Token ids of whole texts. A space between two characters that aren't white space always starts a new pre-token
    of this byte-level pattern, and a line end there is one, so the parts between them are encoded once, kept (up to `most` bytes of them,
    then all are forgotten) and looked up by their bytes. The file's added tokens hold no space and get their own ids
    wherever a text has them. ranks: a file of the same vocabulary as ranks, whose encoder gives the same ids sooner."""

    def __init__(self, path: str, ranks: str | None = None, end_id: int = 0, most: int = 1 << 25):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread, as tasks share the cores
        self.tokenizer, self.most, self.end_id = Tokenizer.from_file(path), most, end_id
        self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        tokenizer = self.tokenizer
        self.plain_ids = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain_ids = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """Place 0 is the end id."""
        self.places: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.bounds = [np.array([self.end_id], np.uint32)], [np.array([0, 1])]

    def _add(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        last = self.bounds[-1][-1]
        at = sum(map(len, self.bounds)) - 1
        self.places.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.ids.append(ids)
        self.bounds.append(last + np.cumsum(sizes))
        self.held += sum(map(len, parts)) + 100 * len(parts)

    def _learn(self, new: list[bytes], group: int = 512) -> None:
        """Plain parts are encoded many at a time: a line end between them is one token of its own."""
        odd, plain = [], []
        for p in new:
            words = p.split()
            (plain if len(words) == 1 and p in (words[0], b" " + words[0]) and len(self.line) == 1 else odd).append(p)
        for at in range(0, len(plain), group):
            some = plain[at : at + group]
            text = b"\n".join(some)
            ids = np.array(self.plain_ids(text.decode()) if not any(a in text for a in self.added) else [], np.uint32)
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) == len(some) - 1 and len(ids):
                self._add(some, np.delete(ids, ends), np.diff(np.r_[-1, ends, len(ids)]) - 1)
            else:
                odd += some
        if odd:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False)]
            self._add(odd, np.concatenate(found), np.array([len(x) for x in found]))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the rows, each with the end id last."""
        if self.held > self.most:
            self._forget()
        rows = len(offs) - 1
        starts = parts_of(buf, offs) if len(buf) else np.zeros(0, np.int64)
        edges = np.append(starts, len(buf)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([p for p in parts if p not in self.places])
        self.ids, self.bounds = [np.concatenate(self.ids)], [np.concatenate(self.bounds)]
        ids, bounds = self.ids[0], self.bounds[0]
        place = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        counts = np.diff(np.searchsorted(starts, offs))
        line = np.zeros(len(starts) + rows, np.int64)
        line[np.arange(len(starts)) + np.repeat(np.arange(rows), counts)] = place[coded.indices.to_numpy()]
        sizes = bounds[line + 1] - bounds[line]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(bounds[line] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.r_[0, ends[np.cumsum(counts + 1) - 1]].astype(np.int64)


def items_of(tokens, loss, size: int, loss_limit: int) -> list[tuple[int, int, int, int]]:
    """(document, start, tokens, loss tokens) of items that meet the limits alone, but for those without loss, which may
    be longer than a sequence. loss: how many tokens bear loss, at the document's end."""
    out = []
    for i, (n, bears) in enumerate(zip(tokens.tolist(), loss.tolist(), strict=True)):
        if n <= size and bears <= loss_limit:
            out.append((i, 0, n, bears))
            continue
        free, step = n - bears, min(size, loss_limit)
        if free:
            out.append((i, 0, free, 0))
        out += [(i, at, min(step, n - at), min(step, n - at)) for at in range(free, n, step)]
    return out


def fill(tokens: np.ndarray, loss: np.ndarray, size: int, segments: int, loss_limit: int):
    """Places documents into sequences: a list of sequences, each a list of (document, start, length).

    tokens, loss: of each document; loss-bearing tokens stand at its end, so a cut piece's loss is what overlaps
    them. Every token is placed once.
    """
    if min(size, segments, loss_limit) < 1:
        raise ValueError("size, segments and loss_limit must be 1 or more")
    out: list[list[tuple[int, int, int]]] = []
    shelves: dict[tuple[int, int], list] = {}

    def shelve(item) -> None:
        shelves.setdefault((item[2].bit_length(), item[3].bit_length()), []).append(item)

    for item in items_of(tokens, loss, size, loss_limit):
        if item[2] == size:
            out.append([item[:3]])
        else:
            shelve(item)
    a, b, c = 1 / size**2, 1 / segments**2, 1 / loss_limit**2
    while shelves:
        room, places, bearing, sequence = size, segments, loss_limit, []
        while room and places and shelves:
            best, score, fits, most = None, -1.0, False, 0
            for key, items in shelves.items():
                _, _, left, had = items[-1]
                take = min(left, room, left - had + bearing)
                if take > 0:
                    whole = take == left
                    if whole < fits:
                        continue
                    dot = take * room * a + places * b + min(had, bearing) * bearing * c
                    if whole > fits or dot > score:
                        best, score, fits, most = key, dot, whole, take
            if best is None:
                break
            i, at, left, had = shelves[best].pop()
            if not shelves[best]:
                del shelves[best]
            sequence.append((i, at, most))
            room, places, bearing = room - most, places - 1, bearing - max(0, most - (left - had))
            if most < left:
                shelve((i, at + most, left - most, min(had, left - most)))
        out.append(sequence)
    return out


def shorten(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two."""
    total, out = sum(x[2] for x in sequence), []
    queue = list(sequence)
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, part = 1 << bit, []
            while room:
                i, at, n = queue.pop(0)
                k = min(n, room)
                part.append((i, at, k))
                room -= k
                if k < n:
                    queue.insert(0, (i, at + k, n - k))
            out.append(part)
    return out


def pack(df, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, loss_share: float = 1.0, size: int = 1024, segments: int = 64, loss_limit: int | None = None, end_id: int = 0, ranks: str | None = None):
    """One row per placed piece: its document, start, length, CRC-32 of its ids, sequence, offset there and loss tokens.

    loss_col: a column with each row's number of loss-bearing tokens at its end (null: none of them); without it
    the last `loss_share` of its tokens, rounded up, bear loss. sequence_id is the partition's number and a counter.
    ranks: the tokenizer's vocabulary once more, as ranks, for speed.
    """
    from pyspark.sql import functions as F

    limit = size if loss_limit is None else loss_limit
    if min(size, segments, limit) < 1 or not 0 <= loss_share <= 1:
        raise ValueError("size, segments and loss_limit must be 1 or more, loss_share 0 to 1")
    small_batches(df.sparkSession)
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(-1) if loss_col is None else F.greatest(F.coalesce(F.col(loss_col), F.lit(0)), F.lit(0))).cast("long").alias("loss"))
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]

    def run(batches):
        from pyspark import TaskContext

        encoder, serial = Encoder(tokenizer, ranks, end_id), TaskContext.get().partitionId() << 40
        ids: list = []
        data: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        loss: list[np.ndarray] = []

        def flush():
            nonlocal serial
            flat, tokens = memoryview(np.concatenate(data)).cast("B"), np.concatenate(sizes)
            base, given = np.r_[0, np.cumsum(tokens)].tolist(), np.concatenate(loss)
            bearing = np.where(given < 0, np.ceil(tokens * loss_share).astype(np.int64), np.minimum(given, tokens))
            free, of = (tokens - bearing).tolist(), tokens.tolist()
            pieces = []
            for sequence in fill(tokens, bearing, size, segments, limit):
                total = sum(x[2] for x in sequence)
                for part in [sequence] if total == size else shorten(sequence):
                    offset = 0
                    for i, at, n in part:
                        b = 4 * (base[i] + at)
                        pieces.append((ids[i], at, n, zlib.crc32(flat[b : b + 4 * n]), of[i], serial, offset, max(0, min(n, at + n - free[i]))))
                        offset += n
                    serial += 1
            for x in (ids, data, sizes, loss):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)

        held = 0
        for batch in batches:
            for at, buf, offs in slices(batch.column("text"), SLICE):
                flat, bounds = encoder.encode(buf, offs)
                n = len(offs) - 1
                ids += batch.column("doc_id").slice(at, n).to_pylist()
                loss.append(batch.column("loss").slice(at, n).to_numpy())
                data.append(flat)
                sizes.append(np.diff(bounds))
                held += len(flat)
                if held >= GROUP_TOKENS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()
        # workers outlive tasks; what an encoder holds would count against later stages
        del encoder
        tidy()

    return picked.mapInArrow(run, SCHEMA)
