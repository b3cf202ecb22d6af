"""MinHash fingerprints: the least value of each of many universal hash functions over a text's 5-word shingles.

Fingerprints of edited texts share the work: shingles of the words before the first difference are hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strandline.llm.common import Shelf, materialize
from strandline.llm.components import components
from strandline.llm.hashing import text_hashes

WORDS, PERMUTATIONS = 5, 128
#: Signature entry of a text without words, and the factor that spreads an entry before it is cut down to 16 bits.
NOTHING, SPREAD = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: Bands of the signature for the candidate search: at a similarity of 0.8 a pair shares one with probability 1 - 4e-8.
BANDS = 32
SIMILAR = 0.8
#: Rows of a piece of a band bucket, about; a task compares two pieces.
SPLIT = 1024
#: Text that is handled together: the corpus over 5000, within these bounds, so that the bounds of all blocks stay few.
BLOCK_BYTES = (4 << 20, 64 << 20)
SEED = 20240607


class MinHasher:
    """Signatures of word sequences; the functions follow from the seed."""

    def __init__(self, permutations: int = PERMUTATIONS, words: int = WORDS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.words, self.permutations = words, permutations
        # x -> a x + b modulo 2**64 with odd a: universal, and a permutation of the 64-bit integers
        self.a = draw.integers(0, 1 << 63, (permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 64, (permutations, 1), dtype=np.uint64)
        self.factors = draw.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        """64-bit hashes of all runs of 5 words; shorter texts are one shingle, texts without words have none."""
        n, k = len(hashes), min(self.words, len(hashes))
        if not n:
            return hashes
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : n - k + 1 + i]) * self.factors[i]
            out ^= out >> np.uint64(29)
        return out

    def signature(self, shingles: np.ndarray, step: int = 512) -> np.ndarray:
        """Least value of each function; NOTHING without shingles."""
        least = np.full(self.permutations, NOTHING, np.uint64)
        room = np.empty((self.permutations, min(step, max(1, len(shingles)))), np.uint64)
        for i in range(0, len(shingles), step):
            x = shingles[i : i + step]
            y = room[:, : len(x)]
            np.multiply(self.a, x, out=y)
            np.add(y, self.b, out=y)
            np.minimum(least, y.min(1), out=least)
        return least

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a text and of an edit of it, from their word hashes."""
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        same = int(differ[0]) if len(differ) else n
        if same < self.words:
            return self.signature(self.shingles(a)), self.signature(self.shingles(b))
        common = self.signature(self.shingles(a[:same]))
        rest = [np.minimum(common, self.signature(self.shingles(x[same - self.words + 1 :]))) if len(x) > same else common for x in (a, b)]
        return rest[0], rest[1]


def _hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    return text_hashes(t.encode("utf-8", "surrogatepass") for t in texts)


def digest(signature: np.ndarray) -> np.ndarray:
    """16 bits of each least value."""
    return (signature * np.uint64(SPREAD) >> np.uint64(48)).astype(np.uint16)


def to_text(d: np.ndarray) -> str:
    return d.astype(">u2").tobytes().hex()


def _bounds(keys: DataFrame, blocks: int) -> np.ndarray:
    """First keys of all blocks but the first: as Spark's range partitioning cuts them, one figure for each block."""
    if blocks < 2:
        return np.zeros(0, np.int64)
    cut = keys.dropna().repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"))
    return np.unique(np.array([r["first"] for r in cut.select("first").collect()], np.int64))[1:]


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every text and its edit: the last quarter of its code points (rounded down) replaced by the first as many of the next text.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hex of the digests), ``near_edited`` and
    ``near_next`` (shares of equal entries with the edit's and the next document's). The next document is that of the next larger
    integer key, and after the last the first; rows of one key follow each other by text, null keys come last. A null text is
    empty; texts without words have one common fingerprint; an empty table gives no rows. The texts are shuffled once, to blocks
    of successive keys; the first document of a block goes to the block before it as well. Block bounds, one key a block, are
    the only thing that passes through the driver.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    total, first = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("doc_id")).first()
    bounds = _bounds(docs.select("doc_id"), -(-total // min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], total // 5000))))
    last, shared = len(bounds), df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf(IntegerType())
    def block_of(doc_id: pd.Series) -> pd.Series:
        """Its block; negative (-1 - block) for the first key of a block."""
        known, key = ~doc_id.isna().to_numpy(), doc_id.fillna(0).to_numpy().astype(np.int64)
        at = np.searchsorted(shared.value, key, side="right")
        begins = known & (at > 0) & (np.append(0, shared.value)[at] == key)
        return pd.Series(np.where(begins, -1 - at, np.where(known, at, last)).astype(np.int32))

    placed = docs.withColumn("mark", block_of("doc_id"))
    placed = placed.withColumns({"block": F.when(F.col("mark") < 0, -1 - F.col("mark")).otherwise(F.col("mark"))})
    begins = F.col("mark") < 0
    # besides its own block, a block's first document goes to the one before, and the very first to the last
    homes = F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("lent")))
    homes = F.when(begins, F.concat(homes, F.array(F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("lent"))))).otherwise(homes)
    homes = F.when(F.col("doc_id").eqNullSafe(F.lit(first)), F.concat(homes, F.array(F.struct(F.lit(last).alias("block"), F.lit(2).alias("lent"))))).otherwise(homes)
    sent = placed.select("doc_id", "text", F.explode(homes).alias("home")).select("home.block", "home.lent", "doc_id", "text")

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("lent").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        own = [r for r in rows if r[0] == 0]
        after = next((r for r in rows if r[0]), own[0] if own else None)
        hasher, out, digests = MinHasher(), [], []

        def edits() -> Iterator[str]:
            for i, (_, _, doc) in enumerate(own):
                follower, quarter = own[i + 1] if i + 1 < len(own) else after, len(doc) // 4
                yield doc[: len(doc) - quarter] + follower[2][:quarter]

        for (_, doc_id, doc), edited, *hashes in zip(own, edits(), _hashes(r[2] for r in own), _hashes(edits())):
            a, b = map(digest, hasher.pair(*hashes))
            digests.append(a)
            out.append((doc_id, len(doc), hashlib.sha256(edited.encode()).hexdigest(), to_text(a), to_text(b), float((a == b).mean())))
        if own:
            (last_hashes,) = _hashes([after[2]])
            digests.append(digest(hasher.signature(hasher.shingles(last_hashes))))
        near_next = [float((x == y).mean()) for x, y in zip(digests, digests[1:])]
        columns = [*zip(*out)] if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited"]
        return pa.table([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(near_next, pa.float64())], names=[*names, "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.groupBy("block").applyInArrow(run, schema)


def _prints(docs: DataFrame) -> DataFrame:
    """``k``, ``content`` (digest of the shingle set) and ``bands`` of every row (``k``, ``t``) with words; different bands have different values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, width = MinHasher(), PERMUTATIONS // BANDS
        draw = np.random.default_rng(SEED + 1)
        mix, apart = (draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (width, BANDS))
        for batch in batches:
            keys, contents, bands = [], [], []
            for k, hashes in zip(batch.column(0), _hashes(t.as_py() for t in batch.column(1))):
                shingles = np.unique(hasher.shingles(hashes))
                if not len(shingles):
                    continue
                keys.append(k.as_py())
                contents.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(((hasher.signature(shingles).reshape(BANDS, width) * mix).sum(1, dtype=np.uint64) + apart).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["k", "content", "bands"])

    return docs.mapInArrow(run, "k long, content binary, bands array<long>")


def _grams(docs: DataFrame) -> DataFrame:
    """``k`` and ``grams`` (different 64-bit hashes of its shingles) of rows (``k``, ``t``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            grams = [np.unique(hasher.shingles(h)).view(np.int64) for h in _hashes(t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["k", "grams"])

    return docs.mapInArrow(run, "k long, grams array<long>")


def _unconnected(table: pa.Table, least: float) -> pa.Table:
    """Links that connect the components of a bucket's rows, or of two of its pieces, as far as their similarity does.

    Pairs that are connected by now, that share an earlier band or whose sizes rule out the similarity are passed over.
    """
    key, component, upper = (table.column(c).to_numpy() for c in ("c", "component", "upper"))
    across, bucket = table.column("i")[0].as_py() != table.column("j")[0].as_py(), table.column("bucket")[0].as_py()
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    lists = table.column("grams").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    known, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    start = np.append(0, np.cumsum(size))
    group, mine, out = np.unique(component, return_inverse=True)[1], np.zeros(len(known), bool), []
    place = np.arange(len(key))
    for x in np.flatnonzero(~upper) if across else place:
        able = (group != group[x]) & (key != key[x]) & (upper if across else place > x) & (size >= least * size[x]) & (size[x] >= least * size)
        rows = np.flatnonzero(able)
        if len(rows):
            equal = bands[rows] == bands[x]
            rows = rows[equal.any(1) & (bands[x][equal.argmax(1)] == bucket)]
        if not len(rows):
            continue
        own = flat[start[x] : start[x + 1]]
        mine[own] = True
        if 8 * len(rows) < len(key):
            both = np.array([mine[flat[start[y] : start[y + 1]]].sum() for y in rows])
        else:
            both = np.add.reduceat(mine[flat], start[:-1], dtype=np.int64)[rows]
        mine[own] = False
        for y in rows[both / (size[x] + size[rows] - both) >= least]:
            if group[y] != group[x]:
                out.append((max(key[x], key[y]), min(key[x], key[y])))
                group[group == group[y]] = group[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR, links: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component`` (its smallest key) of all keys that are linked to another one.

    Two keys are linked if their texts share a band and the Jaccard similarity of their shingle sets, computed from the sets, is ``least`` or more,
    or if ``links`` (``a``, ``b``) says so. All pairs of a band bucket count. Texts with one set of shingles are one class. Each class is first
    compared with the smallest and the largest key of its buckets; then pairs that this left in different components are compared, except where
    the sizes alone rule out the similarity. A pair inside a component can't change the result: rows of a bucket's largest component are sent once for each
    piece of the rows outside it, and only the latter to all pieces. Large buckets are split over tasks.
    Rows without a key or without words have no links of their own; an empty table gives none.
    """
    own = Shelf()
    docs = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("k is not null")
    found = own.put(_prints(docs), "prints")
    classes = own.put(found.groupBy("content").agg(F.min("k").alias("c"), F.first("bands").alias("bands")), "classes")
    same = found.select("k", "content").join(classes.select("content", "c"), "content").filter("k <> c").select(F.col("k").alias("a"), F.col("c").alias("b"))
    known = same if links is None else same.unionByName(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    placed = classes.select("c", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    placed = own.put(placed.join(shared, "bucket"), "buckets")
    involved = placed.select(F.col("c").alias("k")).distinct()
    grams = own.put(_grams(docs.join(involved, "k", "left_semi").dropDuplicates(["k", "t"]).select("k", "t")), "grams")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = pairs.join(grams.select(F.col("k").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("k").alias("b"), F.col("grams").alias("y")), "b")
        sets = sets.filter((F.size("x") >= least * F.size("y")) & (F.size("y") >= least * F.size("x")))
        both = F.size(F.array_intersect("x", "y"))
        return sets.filter(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b").distinct()

    ends = placed.select("c", F.explode(F.array("low", "high")).alias("end")).filter("c <> end")
    near = verified(ends.select(F.greatest("c", "end").alias("a"), F.least("c", "end").alias("b")).distinct())
    groups = materialize(components(near.unionByName(known)), "groups")
    # what is left of each bucket: its pairs with the smallest and the largest key are done
    inner = placed.filter("c <> low and c <> high").join(groups, F.col("c") == F.col("node"), "left").select("bucket", "c", F.coalesce("component", "c").alias("component"))
    inner = own.put(inner, "inner")
    sizes = inner.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.count("*").alias("components"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    pieces = lambda rows: F.ceil(rows / SPLIT).cast("int")
    open_ = open_.filter("components > 1").select("bucket", "largest", pieces(F.col("rows") - F.col("most")).alias("strange"), pieces(F.col("most")).alias("common"))
    # rows of the largest component meet the others' pieces alone; the others meet all
    rest, inside = inner.join(open_, "bucket"), F.col("component") == F.col("largest")
    hashed = F.xxhash64("c")
    piece = F.when(inside, F.col("strange") + F.pmod(hashed, "common")).otherwise(F.pmod(hashed, "strange")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("strange") - 1 + F.when(inside, 0).otherwise(F.col("common"))))
    rest = rest.withColumn("piece", piece).withColumn("other", other).select("bucket", "c", "component", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), (F.col("piece") > F.col("other")).alias("upper"))
    sent = rest.join(grams.withColumnRenamed("k", "c"), "c").join(classes.select("c", "bands"), "c")
    more = own.put(sent.groupBy("bucket", "i", "j").applyInArrow(lambda table: _unconnected(table, least), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    own.clear()
    return groups
