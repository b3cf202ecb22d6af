"""Token ids on disk as directly addressable codes: any token can be read at its place, without decoding those before it.

An id is cut into chunks of bits, lowest first. Level 0 has the lowest chunk of all ids; a bitmap says which ids go on, and level 1 has the next
chunk of those alone, and so on. The place of an id on the next level is the number of set bits before it: a rank directory holds that
number for every 512th place, and the bits between are counted. Widths are chosen for each segment so that it is smallest.

A token set is a folder. ``segments`` has Parquet rows: keys and ends of a run of whole documents, and ``body``, the codes of their ids::

    "DAC1"  u8 levels  u8 width of each level  zeros up to a multiple of 8
    for each level: u64 chunks, then chunks (bits, packed), bitmap (none on the last level), u32 rank directory; each padded to 8 bytes

``directory`` has the number of ids before each part; the documents of all parts follow each other in the order of their keys.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import _slices

MAGIC = b"DAC1"
#: Places between entries of a rank directory.
BLOCK = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 20
#: Bytes of text whose words are held at once; bytes that a worker's words may take, what an entry takes besides its word and ids, and the longest word that is remembered.
STEP, HELD_BYTES, ENTRY, LONG_WORD = 1 << 20, 160 << 20, 160, 64
#: Words that are encoded at once; many more or fewer take longer.
TOGETHER = 150
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def widths(ids: np.ndarray) -> list[int]:
    """The widths of the levels that take the fewest bits: those that go on at each cut pay a bit more, those that don't save the rest."""
    counts = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=2)  # ids by their number of bits
    most = len(counts) - 1
    beyond = [len(ids), *(int(counts[b + 1 :].sum()) for b in range(1, most))]
    best: list[tuple[int, int]] = [(0, 0)] * (most + 1)
    for low in range(most - 1, -1, -1):
        best[low] = min((beyond[low] * (high - low + (high < most)) + best[high][0], high) for high in range(low + 1, most + 1))
    out, low = [], 0
    while low < most:
        out.append(best[low][1] - low)
        low = best[low][1]
    return out


def _packed(values: np.ndarray, width: int) -> bytes:
    """Values of so many bits, one after the other, lowest bit first."""
    kind = "<u2" if width <= 16 else "<u4"
    raw = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def _unpacked(chunks: np.ndarray, width: int, n: int) -> np.ndarray:
    kind, size = ("<u2", 16) if width <= 16 else ("<u4", 32)
    bits = np.zeros((n, size), np.uint8)
    bits[:, :width] = np.unpackbits(chunks, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits.ravel(), bitorder="little").view(kind)


def encode_ids(ids: np.ndarray) -> bytes:
    """The body of a segment: the codes of unsigned 32-bit ids."""
    ids = ids.astype(np.uint32)
    cut = widths(ids)
    head = MAGIC + bytes([len(cut), *cut])
    out, pad = [head, b"\0" * (-len(head) % 8)], lambda b: (b, b"\0" * (-len(b) % 8))
    for k, width in enumerate(cut):
        out.append(struct.pack("<Q", len(ids)))
        out += pad(_packed(ids & np.uint32((1 << width) - 1), width))
        if k + 1 < len(cut):
            ids = ids >> np.uint32(width)
            goes_on = ids > 0
            counts = np.add.reduceat(goes_on, np.arange(0, len(ids), BLOCK), dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)
            out += pad(np.packbits(goes_on, bitorder="little").tobytes())
            out += pad(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
            ids = ids[goes_on]
    return b"".join(out)


class Codes:
    """The codes of a segment, read in place: nothing is decoded but what is asked for."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("no segment of token ids")
        levels = body[4]
        self.widths = list(body[5 : 5 + levels])
        at = 5 + levels + -(5 + levels) % 8
        self.levels = []
        for k, width in enumerate(self.widths):
            (n,) = struct.unpack_from("<Q", body, at)
            at += 8
            size = -(-n * width // 8)
            chunks, at = np.frombuffer(body, np.uint8, size, at), at + size + -size % 8
            bitmap = directory = None
            if k + 1 < levels:
                size, entries = -(-n // 8), -(-n // BLOCK) + 1
                bitmap, at = np.frombuffer(body, np.uint8, size, at), at + size + -size % 8
                directory, at = np.frombuffer(body, "<u4", entries, at), at + 4 * entries + -4 * entries % 8
            self.levels.append((n, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.levels[0][0]

    @staticmethod
    def _chunks(chunks: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        first = at * width
        value = np.zeros(len(at), np.uint64)
        for k in range((width + 14) // 8):  # bytes that a chunk can touch
            place = (first >> 3) + k
            value |= chunks[np.minimum(place, len(chunks) - 1)].astype(np.uint64) << np.uint64(8 * k)
        return value >> (first & 7).astype(np.uint64) & np.uint64((1 << width) - 1)

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's number, and at most BLOCK bits counted."""
        block, size = at // BLOCK, BLOCK // 8
        whole = np.arange(size) + (block * size)[:, None]
        inside = bitmap[np.minimum(whole, len(bitmap) - 1)]
        left = np.clip((at % BLOCK)[:, None] - 8 * np.arange(size), 0, 8)
        return directory[block].astype(np.int64) + np.bitwise_count(inside & ((1 << left) - 1).astype(np.uint8)).sum(1, dtype=np.int64)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < len(self)):
            raise IndexError("no such place")
        out, who, shift = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        for width, (_, chunks, bitmap, directory) in zip(self.widths, self.levels):
            if not len(at):
                break
            out[who] |= self._chunks(chunks, width, at) << np.uint64(shift)
            shift += width
            if bitmap is not None:
                on = np.flatnonzero(bitmap[at >> 3] >> (at & 7) & 1)
                who, at = who[on], self._rank(bitmap, directory, at[on])
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        """All ids: each level is spread over those of the level before that go on."""
        out, who, shift = np.zeros(len(self), np.uint32), np.arange(len(self)), 0
        for width, (n, chunks, bitmap, _) in zip(self.widths, self.levels):
            out[who] |= _unpacked(chunks, width, n).astype(np.uint32) << np.uint32(shift)
            shift += width
            if bitmap is not None:
                who = who[np.unpackbits(bitmap, count=n, bitorder="little").view(bool)]
        return out


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, with a file of the tokenizers library."""

    def __init__(self, model: str, cut_at_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_str(model), cut_at_blanks
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Encodes words some hundred at a time, a blank between them; where their tokens begin tells them apart."""
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            words = b" ".join(some).decode()
            found = self.tokenizer.encode(words, add_special_tokens=False)
            ids, begin, at = np.array(found.ids, "<u4").tobytes(), [a for a, _ in found.offsets], [0]
            for w in words.split(" "):
                at.append(at[-1] + len(w) + 1)
            cuts = [4 * bisect_left(begin, a) for a in at]
            self.known.update(zip(some, (ids[a:b] for a, b in zip(cuts, cuts[1:]))))

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        known, words = self.known, [t.split() for t in texts]
        new = list(set(chain.from_iterable(words)).difference(known))
        if new:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:  # a full memory stays as it is: common words were met early
            if len(w) > LONG_WORD or self.held > HELD_BYTES:
                del known[w]
            else:
                self.held += len(w) + len(known[w]) + ENTRY
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.cut:
            for a, b in _slices(texts):
                yield from self._encoded(texts[a:b])
            return
        for a, b in _slices(texts, STEP):
            if b - a > 1 or len(texts[a]) <= 2 * STEP:
                yield from self._by_words(texts[a:b])
                continue
            text, out, at = texts[a], [], 0
            while at < len(text):  # a long text, a piece at a time
                blank = BLANK.search(text, at + STEP)
                end = blank.start() if blank else len(text)
                out += self._by_words([text[at:end]])
                at = end
            yield b"".join(out)


@lru_cache(maxsize=1)
def _encoder(model: str, cut_at_blanks: bool) -> Encoder:
    """A worker's encoder, which the next of its tasks finds with the words that it knows."""
    return Encoder(model, cut_at_blanks)


def _schema(kind: str) -> str:
    return f"part int, segment int, begin long, n_ids long, keys array<{kind}>, ends array<long>, body binary"


def write_tokens(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, cut_at_blanks: bool = False) -> None:
    """Encodes every whole text and writes a token set: the ids of the documents in ascending order of their keys, each followed by ``end_id``.

    The tokenizer is a file of the tokenizers library, read by the driver; truncation, padding and added special tokens are off, special tokens that
    a text spells out count as the library has it. ``cut_at_blanks`` says that the file's tokens never hold an ASCII blank and that words on both sides
    of one are encoded as if alone, as with vocabularies that drop white space; a task then encodes different words once. A null text is empty; null keys come last; rows that share a key follow each other by
    their texts' hashes, then texts; repeated rows stay; other columns are ignored; an empty table gives a set without segments. Texts are
    dealt by ranges of keys and sorted; rows of one key *and* text share a task. A segment holds whole documents.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        encoder = _encoder(model.value, cut_at_blanks)
        part, segment, begin = TaskContext.get().partitionId(), 0, 0
        keys, ends, held, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal keys, ends, held, size, segment, begin
            ids = np.frombuffer(b"".join(held), "<u4")
            lists = [pa.array([pa.concat_arrays(keys).tolist()], pa.list_(keys[0].type)), pa.array([ends], pa.list_(pa.int64()))]
            out = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([begin], pa.int64()), pa.array([len(ids)], pa.int64()), *lists, pa.array([encode_ids(ids)], pa.binary())]
            begin, segment = begin + size, segment + 1
            keys, ends, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(out, names=["part", "segment", "begin", "n_ids", "keys", "ends", "body"])

        tail = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in batches:
            for i, ids in enumerate(encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                held += [ids, tail]
                size += (len(ids) + len(tail)) // 4
                ends.append(size)
                keys.append(batch.column(0).slice(i, 1))
                if size >= SEGMENT_IDS:
                    yield closed()
        if held:
            yield closed()

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.asc_nulls_last("k"), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("k", "t")
    rows.mapInArrow(run, _schema(kind.simpleString())).write.parquet(f"{path}/segments")
    spark = df.sparkSession
    sizes = spark.read.schema(_schema(kind.simpleString())).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).write.parquet(f"{path}/directory")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before each."""
    directory = spark.read.schema("part int, base long").parquet(f"{path}/directory")
    # a row for each part
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(directory), "part").withColumn("start", F.col("base") + F.col("begin"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every document of a token set.

    The ids are decoded from the files; a segment whose codes don't have as many ids as its documents fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, ends, body in zip(*(batch.column(c) for c in ("start", "keys", "ends", "body"))):
                ids, ends = Codes(body.as_py()).all(), ends.values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                if len(ids) != ends[-1]:
                    raise ValueError(f"a segment has {len(ids)} ids, its documents {ends[-1]}")
                for a in range(0, len(ends), 2000):
                    s, e = starts[a : a + 2000], ends[a : a + 2000]
                    packed = [ids[i:j].astype("<u4").tobytes() for i, j in zip(s.tolist(), e.tolist())]
                    yield pa.RecordBatch.from_arrays([keys.values.slice(a, len(s)), pa.array(start.as_py() + s), pa.array(e - s), pa.array(packed, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    segments = _segments(spark, path).select("start", "keys", "ends", "body")
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    return segments.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def tokens_at(places: DataFrame, path: str, place: str = "place") -> DataFrame:
    """``place`` and ``id`` of every different place of a token set that is asked for, counted over all documents.

    Places are joined with the segments by bins of ids and looked up in the codes; nothing else is decoded. What a task holds is
    a segment and at most each of its places once. Null places, and places that the set doesn't have, give no rows.
    """
    spark = places.sparkSession
    segments, bodies = _segments(spark, path), _segments(spark, path).select("part", "segment", "start", "body")
    bins = F.sequence(F.col("start").bitwiseAND(-SEGMENT_IDS), F.col("start") + F.col("n_ids") - 1, F.lit(SEGMENT_IDS))
    listed = segments.select("part", "segment", "start", "n_ids", F.explode(bins).alias("bin"))
    wanted = places.select(F.col(place).cast("long").alias("place")).filter("place IS NOT NULL").distinct()
    wanted = wanted.withColumn("bin", F.col("place").bitwiseAND(-SEGMENT_IDS)).join(listed, "bin")
    wanted = wanted.filter("place >= start AND place < start + n_ids").select("part", "segment", (F.col("place") - F.col("start")).alias("at"))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"place": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        at = asked["at"].to_numpy()
        ids = Codes(held["body"][0].as_py()).take(at)
        return pa.table({"place": at + held["start"][0].as_py(), "id": ids.astype(np.int64)})

    return wanted.groupBy("part", "segment").cogroup(bodies.groupBy("part", "segment")).applyInArrow(run, "place long, id long")
