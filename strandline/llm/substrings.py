"""Substring dedup: words covered by long windows that start in an earlier document too, found behind a count-min prefilter.

Documents are dealt into blocks. Three passes over the blocks, whose texts are shuffled once, do the work:

1. *Sketch.* Every window has an anchor, the least hash among the half-length windows in it; equal windows have equal anchors.
   A block's count-min sketch of its anchors (by document) is sparse: the sorted list of the counters it touches, gaps coded in
   about ten bits. Sketches are merged by ranges of counters, and each block is told which of its counters reached two. No window that
   occurs in two documents is lost, as its anchor counts at least as often.
2. *Exact count.* A block lists its windows whose anchor is estimated repeated: a 128-bit hash (two trees of mixed sums over word hashes of two
   seeds) and the smallest document, once for each different window. Ranges of hashes are merged, and each block is told where another block has a smaller document. A window that very
   many documents share comes once from each block.
3. *Removal.* The block marks the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh
from strandline.llm.hashing import BASES, mixed, word_hashes, words_of

WINDOW = 50
#: Rows of the sketch, and counters in a row for each expected anchor.
DEPTH, COUNTERS = 2, 4
#: Bytes of text for each block: the corpus over 5000, within these bounds; bytes of text for each anchor, about.
BLOCK_BYTES, ANCHOR_BYTES = (4 << 20, 64 << 20), 80
#: Anchors, and bytes of text, for each range that is merged at once: the first figure up to MANY_RANGES, the second beyond. They bound a task's memory.
RANGE_ANCHORS, RANGE_BYTES, MANY_RANGES = (1 << 18, 1 << 23), (8 << 20, 32 << 20), 4096
NO_KEY = np.iinfo(np.int64).max


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by doubling; both halves' hashes are mixed, as pure polynomials modulo 2^64 confuse some long runs under every base."""
    out, power, length = None, hashes, 1
    done, factor = 0, base  # factor: base to the power of length
    while True:
        if size & length:
            here = power[done:]
            out = here if out is None else mixed(out[: len(here)] * np.uint64(factor) + here[: len(out)])
            done += length
        if done == size:
            return mixed(out)
        if len(power) <= length:
            return np.zeros(0, np.uint64)
        power = mixed(power[:-length] * np.uint64(factor) + power[length:])
        factor, length = factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * length


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every run of ``size`` values."""
    length = 1
    while 2 * length <= size:
        values, length = np.minimum(values[:-length], values[length:]), 2 * length
    rest = size - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def pack(cells: np.ndarray) -> bytes:
    """Rice code of sorted integers: whole bytes of each gap, and how often the next power fits, in unary."""
    gaps = np.diff(cells, prepend=0).astype(np.uint64)
    n = len(gaps)
    width = min((1, 2, 3, 4), key=lambda w: n * w + (int((gaps >> np.uint64(8 * w)).sum()) + n) // 8)
    low = gaps.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
    ends = np.cumsum((gaps >> np.uint64(8 * width)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    return n.to_bytes(4, "little") + bytes([width]) + low + np.packbits(unary).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(n, width)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=5 + n * width)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.cumsum(low.view("<u8").ravel().astype(np.int64) + (high << (8 * width)))


class Block:
    """Windows and anchors of the documents of one block."""

    def __init__(self, keys: np.ndarray, texts: list[bytes], window: int):
        self.keys, self.window = keys, window
        self.raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.words = words_of(self.raw)
        self.hashes = word_hashes(self.raw, *self.words)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.starts = np.concatenate([[0], np.searchsorted(self.words[0], ends)])
        n, sizes = len(self.hashes), np.diff(self.starts)
        document = np.repeat(np.arange(len(texts)), sizes)
        room = np.repeat(self.starts[1:], sizes) - np.arange(n)
        self.at = np.flatnonzero(room >= window)  # where a window starts
        self.document = document[self.at]
        half = (window + 1) // 2
        anchors = _least(rolling(self.hashes, half, BASES[0]), window - half + 1) if n >= window else np.zeros(0, np.uint64)
        self.anchor = anchors[self.at]
        # the anchors of each document, once
        first = np.ones(len(self.at), bool)
        first[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.document[1:] != self.document[:-1])
        a, d = self.anchor[first], self.document[first]
        order = np.lexsort((a, d))
        a, d = a[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        self.anchors = a[new]

    def counters(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The counters that the anchors touch in a row of the sketch, sorted, and which anchor each stands for."""
        cells = (mixed(self.anchors, row + 1) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(cells, kind="stable")
        return cells[order], order

    def repeated(self, flags: list[np.ndarray], bits: int) -> np.ndarray:
        """Window starts (places in ``at``) whose anchor reached two in all rows; flags: for each row, for the sorted counters."""
        good = np.ones(len(self.anchors), bool)
        for row, flag in enumerate(flags):
            told = np.zeros(len(self.anchors), bool)
            told[self.counters(row, bits)[1]] = flag
            good &= told
        kept = np.unique(self.anchors[good])
        if not len(kept):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(kept, self.anchor), len(kept) - 1)
        return np.flatnonzero(kept[place] == self.anchor)

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the least key of each different window among the chosen, sorted by hash; and the entry of each chosen window."""
        start = self.at[chosen]
        h1 = h2 = np.zeros(0, np.uint64)
        if len(start):
            h1 = rolling(self.hashes, self.window, BASES[0])[start]
            h2 = rolling(word_hashes(self.raw, *self.words, seed=1), self.window, BASES[1])[start]
        key = self.keys[self.document[chosen]]
        order = np.lexsort((key, h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        entry = np.zeros(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        return a[new], b[new], key[order][new], entry

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """Which words the chosen windows cover."""
        change = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(change, self.at[chosen], 1)
        np.add.at(change, self.at[chosen] + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _ranges(amount: float, each: tuple[int, int]) -> int:
    """A power of two: so many ranges that each has about the first figure; beyond MANY_RANGES they grow to the second, and no further."""
    return max(min(MANY_RANGES, _power_of_two(amount / each[0])), _power_of_two(amount / each[1]))


def _pieces(values: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """Runs of the sorted values by range (their bits above the shift)."""
    which = (values >> values.dtype.type(shift)).astype(np.int64) if shift < 64 else np.zeros(len(values), np.int64)
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)]):
        yield int(which[a]), slice(a, b)


def _bits_in_order(rows: list[tuple[int, bytes, int]]) -> np.ndarray:
    """Bits of all ranges, one after the other: rows of range, packed bits, count."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for _, b, n in sorted(rows)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, new_text: str = "kept") -> DataFrame:
    """Removes from each text the words covered by a window of words that also starts in a row with a smaller key.

    Adds ``n_words``, ``n_removed`` (long) and ``kept`` (the words left, joined by one space); the given columns stay. Windows are
    judged on the input. Repeats inside one document, or between rows of one key, remove nothing; a null key counts as larger than all;
    a null or empty text, or one shorter than a window, loses nothing; an empty table gives no rows. Keys are integers. Columns
    of the input named like new ones are replaced.
    """
    names = [c for c in df.columns if c.lower() not in {"n_words", "n_removed", new_text.lower()}]
    (b_name,) = fresh(df, "block")
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], total // 5000))))
    bits = _power_of_two(COUNTERS * total / ANCHOR_BYTES + 1024).bit_length() - 1
    ranges = _ranges((1 << bits) / COUNTERS, RANGE_ANCHORS)
    shift = bits - (ranges.bit_length() - 1)
    parts = _ranges(total, RANGE_BYTES)
    hash_shift = 64 - (parts.bit_length() - 1)
    blocked = df.select(
        *names,
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias(b_name),
    )

    def read(table: pa.Table) -> tuple[Block, list[bytes]]:
        texts = [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]
        keys = table.column(key).cast(pa.int64()).fill_null(NO_KEY).to_numpy()
        return Block(keys, texts, window), texts

    def sketch(table: pa.Table) -> pa.Table:
        block, out = read(table)[0], []
        number = table.column(b_name)[0].as_py()
        for row in range(DEPTH):
            cells, _ = block.counters(row, bits)
            for r, run in _pieces(cells, shift):
                out.append((number, row, r, pack(cells[run] - (r << shift))))
        columns = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "row", "range", "cells"])

    def merge_counters(table: pa.Table) -> pa.Table:
        cells = [unpack(c) for c in table.column("cells").to_pylist()]
        every = np.sort(np.concatenate(cells))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flags = []
        for c in cells:
            place = np.minimum(np.searchsorted(twice, c), len(twice) - 1)
            flags.append(np.packbits(twice[place] == c if len(twice) else np.zeros(len(c), bool)).tobytes())
        return pa.table({"block": table.column("block"), "row": table.column("row"), "range": table.column("range"), "flags": pa.array(flags, pa.binary()), "n": pa.array(map(len, cells), pa.int32())})

    def flagged(block: Block, told: list[dict]) -> np.ndarray:
        flags = [_bits_in_order([(x["range"], x["flags"], x["n"]) for x in told if x["row"] == row]) for row in range(DEPTH)]
        return block.repeated(flags, bits)

    def count(table: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            block = read(table)[0]
            number = table.column(b_name)[0].as_py()
            h1, h2, least, _ = block.entries(flagged(block, told.to_pylist()))
            out = [(number, r, h1[s].tobytes(), h2[s].tobytes(), least[s].tobytes()) for r, s in _pieces(h1, hash_shift)]
        columns = zip(*out) if out else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "range", "h1", "h2", "least"])

    def merge_windows(table: pa.Table) -> pa.Table:
        h1, h2, least = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("h1", np.uint64), ("h2", np.uint64), ("least", np.int64)))
        sizes = list(map(len, h1))
        a, b, k = map(np.concatenate, (h1, h2, least))
        order = np.lexsort((k, b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.zeros(len(a), np.int64)
        first[order] = k[order][new][np.cumsum(new) - 1]
        hit = np.split(first < k, np.cumsum(sizes)[:-1])
        bits_ = [np.packbits(x).tobytes() for x in hit]
        # the row -1 tells these bits from those of the sketch
        return pa.table({"block": table.column("block"), "row": pa.array([-1] * len(sizes), pa.int32()), "range": table.column("range"), "flags": pa.array(bits_, pa.binary()), "n": pa.array(sizes, pa.int32())})

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        block, texts = read(table) if table.num_rows else (None, [])
        n_words, n_removed, kept = [], [], []
        if block is not None:
            known = told.to_pylist()
            chosen = flagged(block, [x for x in known if x["row"] >= 0])
            _, _, least, entry = block.entries(chosen)
            elsewhere = _bits_in_order([(x["range"], x["flags"], x["n"]) for x in known if x["row"] < 0])
            gone = block.covered(chosen[elsewhere[entry] | (block.keys[block.document[chosen]] > least[entry])]) if len(chosen) else np.zeros(len(block.hashes), bool)
            for i, t in enumerate(texts):
                mask = gone[block.starts[i] : block.starts[i + 1]]
                words = t.split()
                n_words.append(len(words))
                n_removed.append(int(mask.sum()))
                kept.append(b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if n_removed[-1] else words))
        out = table.select(names) if table.num_rows else pa.table([pa.array([], f.type) for f in table.schema if f.name in names], names=names)
        for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), (new_text, kept, pa.binary())):
            column = pa.array(values, kind)
            out = out.append_column(name, column.cast(pa.string()) if kind == pa.binary() else column)
        return out

    flags = blocked.groupBy(b_name).applyInArrow(sketch, "block int, row int, range int, cells binary")
    flags = flags.groupBy("row", "range").applyInArrow(merge_counters, "block int, row int, range int, flags binary, n int")
    windows = blocked.groupBy(b_name).cogroup(flags.groupBy("block")).applyInArrow(count, "block int, range int, h1 binary, h2 binary, least binary")
    hits = windows.groupBy("range").applyInArrow(merge_windows, "block int, row int, range int, flags binary, n int")
    told = flags.unionByName(hits)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return blocked.groupBy(b_name).cogroup(told.groupBy("block")).applyInArrow(remove, f"{kinds}, n_words long, n_removed long, `{new_text}` string")
