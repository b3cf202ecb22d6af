"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves along a binary trie.

A fingerprint is put into one trie for each of budget + 1 rotations of its bits. Two fingerprints within the budget agree in all bits of at least
one of so many parts, and so share the first nodes of the trie whose bits begin with that part: Spark deals the tries by a node of this
cut, and no pair of nodes across the cut needs a visit. A task then walks a subtree with itself, both sides together, adds up the
bits in which the paths differ and leaves a pair of nodes as soon as they are more than the budget. A subtree with very many
fingerprints is dealt into pieces, and tasks walk pairs of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, materialize
from strandline.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Most fingerprints of a subtree, about, that a task walks whole; and how many it should have at least where that leaves enough tasks.
SUBTREE, LEAST_SUBTREE = 32768, 64
#: Pairs of trie nodes that a task holds at a time.
NODE_PAIRS = 1 << 18


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's shingles, repeats included; 0 without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    grams = w
    for i in range(1, words):
        grams = [x + b" " + y for x, y in zip(grams, w[i:])]
    if not grams:
        grams = [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(grams), step):
        h = np.fromiter((digest(g, 42) for g in grams[i : i + step]), np.uint64, min(step, len(grams) - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """Adds ``fp`` (the 64 bits as a long) and drops the text. A null text has no words; equal texts have equal fingerprints."""
    columns = [c for c in df.columns if c != text and c.lower() != "fp"]
    (hidden,) = fresh(df, "simhash_text")
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(hidden)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fp)], names=[*columns, "fp"])

    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(hidden)).mapInArrow(run, f"{kinds}fp long")


def _walk(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in the sorted arrays a and b whose values differ in at most ``budget`` of 64 bits; each pair once if both are the same.

    All pairs of trie nodes of one level are held as ranges of the arrays and go down together. a and b are each below one node at the depth.
    """
    first = bin(int(a[0] ^ b[0]) >> (64 - depth)).count("1") if depth else 0
    if first > budget:
        return
    work = [(depth, np.array([[0, len(a), 0, len(b), first]], np.int64))]
    while work:
        level, pairs = work.pop()
        if len(pairs) > NODE_PAIRS:
            half = len(pairs) // 2
            work += [(level, pairs[half:]), (level, pairs[:half])]
            continue
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 8
        if few.any():  # small pairs of nodes are compared at once: place by place of their products
            alo, ahi, blo, bhi = pairs[few, :4].T
            wide = bhi - blo
            count = (ahi - alo) * wide
            at = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            i, j = alo[at] + k // wide[at], blo[at] + k % wide[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        pairs = pairs[~few]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        cut = []
        for values, lo, hi in ((a, pairs[:, 0], pairs[:, 1]), (b, pairs[:, 2], pairs[:, 3])):
            low, high = lo.copy(), hi.copy()  # the first place in the range with the bit set
            while (open_ := low < high).any():
                mid = (low + high) // 2
                is_set = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
                high = np.where(open_ & is_set, mid, high)
                low = np.where(open_ & ~is_set, mid + 1, low)
            cut.append(low)
        sides = lambda c, lo, hi, one: (c, hi) if one else (lo, c)
        down = []
        for x in (0, 1):
            for y in (0, 1):
                alo, ahi = sides(cut[0], pairs[:, 0], pairs[:, 1], x)
                blo, bhi = sides(cut[1], pairs[:, 2], pairs[:, 3], y)
                errors = pairs[:, 4] + (x != y)
                keep = (alo < ahi) & (blo < bhi) & (errors <= budget)
                if same:  # of two mirrored pairs of nodes only one goes on
                    keep &= alo <= blo
                down.append(np.stack([alo, ahi, blo, bhi, errors], 1)[keep])
        work.append((level + 1, np.concatenate(down)))


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that connect what was not connected yet: as many components, fewer links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for i, j in pairs:
        for x, y in zip(a[i].tolist(), b[j].tolist()):
            if (r := root(x)) != (s := root(y)):
                parent[r] = s
                out.append((x, y))
    return out


def links(values: DataFrame, budget: int = 2, subtree: int = SUBTREE) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints (column ``fp``, each once) that connect all within ``budget`` differing bits.

    Any two fingerprints within the budget are connected by the links returned, directly or over others within it. Each is sent
    budget + 1 times. The cut is as deep as the fingerprints and the shuffle partitions ask for; a node that still has more than ``subtree``
    fingerprints, however alike they are, is split into pieces of that size. No values, no links.
    """
    turns = budget + 1
    part, count = 64 // turns, values.count()
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deep = lambda x: max(0, int(np.ceil(np.log2(max(x, 1)))))
    depth = min(part, max(deep(2 * count / subtree), min(deep(2 * tasks / turns), deep(count / LEAST_SUBTREE))))
    turned = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: F.struct(t.alias("turn"), _rotated(F.col("fp"), t * part).alias("path")))
    keyed = values.select(F.inline(turned)).withColumn("node", F.expr(f"shiftrightunsigned(path, {64 - depth})") if depth else F.lit(0).cast("long"))
    large = keyed.groupBy("turn", "node").count().filter(F.col("count") > subtree).withColumn("pieces", F.ceil(F.col("count") / subtree).cast("int"))
    split = keyed.join(large.drop("count"), ["turn", "node"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    split = split.withColumns({"piece": F.pmod(F.xxhash64("path"), F.col("pieces")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))})
    sent = split.select("turn", "node", "path", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), (F.col("piece") > F.col("other")).alias("upper"))

    def unturned(path: np.ndarray, turn: int) -> np.ndarray:
        k = turn * part
        return path if not k else path >> np.uint64(k) | path << np.uint64(64 - k)

    def agree_before(x: np.ndarray, turn: int) -> np.ndarray:
        """Whether the differences leave out all bits of an earlier turn's cut: the pair was found there."""
        out = np.zeros(len(x), bool)
        for t in range(turn if depth else 0):
            out |= (x << np.uint64(t * part)) >> np.uint64(64 - depth) == 0
        return out

    def run(table: pa.Table) -> pa.Table:
        turn, within = table.column("turn")[0].as_py(), table.column("low")[0].as_py() == table.column("high")[0].as_py()
        path, upper = table.column("path").to_numpy().view(np.uint64), table.column("upper").to_numpy()
        a, b = np.sort(path[~upper]), np.sort(path[upper])
        if within:
            b = a
        own_a, own_b = unturned(a, turn), unturned(b, turn)
        found = []
        if len(a) and len(b) and (not within or len(a) > 1):
            pairs = ((i[new], j[new]) for i, j in _walk(a, b, depth, budget, within) for new in [~agree_before(own_a[i] ^ own_b[j], turn)])
            found = _forest(pairs, own_a.view(np.int64), own_b.view(np.int64))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return sent.groupBy("turn", "node", "low", "high").applyInArrow(run, "a long, b long")


def _rotated(fp: Column, bits: Column) -> Column:
    """The 64 bits turned to the left."""
    return F.call_function("shiftleft", fp, bits).bitwiseOR(F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", fp, 64 - bits)))


def _by_fingerprint(df: DataFrame, key: str, text: str, words: int, budget: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The rows with ``fp``; the different fingerprints with their smallest key; the links between them; the name of that key. All stored."""
    columns = [c for c in df.columns if c.lower() not in {"fp", "component_id"}]
    (name,) = fresh(df, "simhash_key")
    rows = materialize(fingerprints(df.select(*[c for c in columns if c != text], text), text, words), "fingerprints")
    values = materialize(rows.groupBy("fp").agg(F.min(key).alias(name)), "different")
    return rows, values, links(values.select("fp"), budget), name


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """All rows without their text, with ``fp``, and ``component_id``: the smallest key whose fingerprint can be reached over links.

    Fingerprints link at ``budget`` or fewer differing bits. Null and empty texts have fingerprint zero and link like any other;
    null keys are never a component's id unless it has no other (then it is null); repeated rows stay; an empty table gives no rows.
    Copies meet as one fingerprint; only different fingerprints are joined. Fingerprints without texts are stored once.
    """
    rows, values, found, name = _by_fingerprint(df, key, text, words, budget)
    found = components(found)
    least = found.join(values, found["node"] == values["fp"]).groupBy("component").agg(F.min(name).alias("_least"))
    named = found.join(least, "component").select(F.col("node").alias("fp"), "_least")
    ids = values.join(named, "fp", "left").select("fp", F.coalesce("_least", name).alias("component_id"))
    return rows.join(ids, "fp")


def duplicate_links(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """Links ``a``, ``b`` of keys that connect what :func:`near_duplicates` puts into one component, for use with other links. Null keys have none."""
    rows, values, found, name = _by_fingerprint(df.select(key, text), key, text, words, budget)
    copies = rows.join(values, "fp").filter(F.col(key) != F.col(name)).select(F.col(key).alias("a"), F.col(name).alias("b"))
    ends = [values.select(F.col("fp").alias(e), F.col(name).alias(f"key_{e}")) for e in "ab"]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).dropna()
    return copies.unionByName(near)
