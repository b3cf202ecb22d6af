"""Byte-level BPE encoding by speculation: greedy longest match proposes tokens, vectorised checks of adjacent pairs accept them.

For two neighbouring tokens the merges that can cross their border join a token of the left one's right edge with
one of the right one's left edge. Such an edge token lives until the merge that swallows it. A pair is compatible if no
crossing merge ranks before both ends' deaths (at equal rank the leftmost merge runs first). If every token encodes
to itself and every adjacent pair is compatible, the proposal is what merging in order of rank gives. Words with an
incompatible pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from strandline.llm.common import fresh

#: The pre-tokenizer's pattern of byte-level BPE vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Never dies.
FOREVER = 1 << 30
#: Bytes that a worker's remembered words may take, what an entry takes besides its word and ids, and the longest word, in characters, that is remembered. They bound its memory, not the result.
HELD_BYTES, ENTRY, LONG_WORD = 160 << 20, 180, 64


def byte_characters() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and edge tables of a byte-level BPE file; plain arrays and dicts, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte = byte_characters()
        raw = lambda t: bytes(to_byte[c] for c in t)
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for t, i in vocab.items():
            self.token[i] = raw(t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.id = {raw(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        left, right, born = (np.full(self.size, -1, np.int64) for _ in range(3))
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = rank
            self.merged.append(z)
            if born[z] < 0:
                left[z], right[z], born[z] = x, y, rank
        keys = np.array([x * self.size + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.left_edge, self.right_edge = (self._edges(side, born) for side in (left, right))
        self.longest = max(map(len, self.id))
        starts: dict[bytes, set[int]] = {}
        for t in self.id:
            for n in range(1, 5):  # by up to four first bytes: the lengths of tokens that begin so
                starts.setdefault(t[:n], set()).add(len(t))
        self.lengths = {k: sorted((n for n in v if len(k) == 4 or n <= len(k)), reverse=True) for k, v in starts.items()}
        self.sound = np.zeros(self.size, bool)  # tokens whose own bytes encode to them
        for t, i in self.id.items():
            self.sound[i] = self.exact(t) == [i]

    @staticmethod
    def _edges(side: np.ndarray, born: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth: the edge token below every token (-1: none), and the rank at which it dies."""
        token, dies = np.arange(len(side)), np.full(len(side), FOREVER)
        out = []
        while (token >= 0).any():
            out.append((token, dies))
            dies = np.where(token >= 0, born[token], -1)
            token = np.where((token >= 0) & (dies >= 0), side[token], -1)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 200:
            return self._exact_long(ids)
        rank, merged = self.rank.get, self.merged
        ranks = [rank(p, FOREVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < FOREVER:
            i = ranks.index(best)
            ids[i : i + 2] = [merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), FOREVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), FOREVER)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words without blanks of any length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.rank.get((ids[i], ids[j])) != best:
                continue
            ids[i], ids[j] = self.merged[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := self.rank.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        whole = self.id.get(word)
        if whole is not None:
            return [whole]
        out, i, n, token, lengths = [], 0, len(word), self.id.get, self.lengths.get
        while i < n:
            for start in (4, 3, 2, 1):
                found = None
                for size in lengths(word[i : i + start], ()):
                    found = token(word[i : i + size]) if i + size <= n else None
                    if found is not None:
                        break
                if found is not None:
                    break
            out.append(found)
            i += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging never crosses its border."""
        good = self.sound[a] & self.sound[b]
        for right, right_dies in self.right_edge:
            for left, left_dies in self.left_edge:
                at = np.flatnonzero(good & (right[a] >= 0) & (left[b] >= 0))
                if not len(at):
                    continue
                x, y = a[at], b[at]
                key = right[x] * self.size + left[y]
                place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], FOREVER)
                good[at[(rank < right_dies[x]) & (rank <= left_dies[y]) & (rank < FOREVER)]] = False
        return good

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words had to be merged exactly."""
        if not words:
            return [], 0
        tokens = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for w in tokens for t in w), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        failed = np.zeros(len(words), bool)
        failed[word[~self.sound[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        if len(pairs):
            failed[word[inner[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = True
        for i in np.flatnonzero(failed):
            tokens[i] = self.exact(words[i])
        return tokens, int(failed.sum())


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A file's vocabulary, built once by the driver."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a vocabulary; remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v, self.known, self.held = vocabulary, {}, 0
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True)) + ")").split if vocabulary.special else lambda t: [t]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known, special = self.known, self.v.special
        cut = [self.cut(t) if any(s in t for s in special) else [t] for t in texts]
        found = [[[p] if p in special and k % 2 else self.words(p) for k, p in enumerate(parts)] for parts in cut]
        new = list({w for parts in found for k, ws in enumerate(parts) if not (k % 2) for w in ws if w not in known})
        tokens, _ = self.v.encode_words([w.encode() for w in new])
        known.update(zip(new, (np.array(t, "<u4").tobytes() for t in tokens)))
        out = []
        for parts in found:
            ids = [np.array([special[ws[0]]], "<u4").tobytes() if k % 2 else b"".join([known[w] for w in ws]) for k, ws in enumerate(parts)]
            out.append(b"".join(ids))
        for w in new:  # a full memory stays as it is: common words were met early
            if len(w) > LONG_WORD or self.held > HELD_BYTES:
                del known[w]
            else:
                self.held += 4 * len(w) + len(known[w]) + ENTRY
        return out

    def decode(self, ids: bytes) -> str:
        token = self.v.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _slices(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters, to bound what is held at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int), ``n_tokens`` (long) and ``decoded_sha256`` (of the text that the ids decode to) to every row.

    With ``keep_text=False`` the text column goes; columns named like the new ones are replaced.

    A null text counts as empty and gives no ids. Special tokens that a text spells out become their ids, as the
    tokenizers library does by default. Equal rows give equal ids; an empty table gives none. The vocabulary, of
    fixed size, is read by the driver and broadcast.
    """
    columns = [c for c in df.columns if (keep_text or c != text) and c.lower() not in {ids.lower(), "n_tokens", "decoded_sha256"}]
    (hidden,) = fresh(df, "bpe_text")
    model = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            texts = batch.column(hidden).to_pylist()
            for a, b in _slices(texts):
                packed = encoder.encode_batch(texts[a:b])
                decoded = pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in packed])
                got = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
                counts = pa.array(map(len, got), pa.int64())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), values, counts, decoded], names=[*columns, ids, "n_tokens", "decoded_sha256"])

    new = [StructField(ids, ArrayType(IntegerType(), False)), StructField("n_tokens", LongType()), StructField("decoded_sha256", StringType())]
    schema = StructType([*(df.schema[c] for c in columns), *new])
    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(hidden)).mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``. Nulls and repeats as in :func:`encode`."""
    model = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = encoder.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
