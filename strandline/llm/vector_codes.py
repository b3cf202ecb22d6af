"""Product quantisation of integer vectors whose distances are exact: dot products by limbs in float64, put together in int64.

A component becomes ``floor(1024 * x)``. A vector is cut into equal parts, and each part position has a codebook of at most 256
entries. Squared distances are ``|x|^2 - 2 x.c + |c|^2``. The dot products of a batch are one matrix product for each pair of limbs:
integers are cut into limbs so short that a product over a part stays below 2**53, where float64 sums of integers are exact in any
order. Every machine and any partitioning therefore gives the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Shelf, materialize

#: A component's unit is a SCALE-th.
SCALE = 1024
#: Rows whose distances to a codebook are held at once.
ROWS = 4096


def limbs_of(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, lowest first: all but the highest are below ``2**bits`` and not negative, the highest is at most that in magnitude."""
    out = []
    while True:
        high = x >> bits
        if ((high == 0) | (high == -1)).all():
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = high


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of int64 matrices, exactly, where the true values are within int64."""
    # a product over all columns is at most 2**(2 * bits) * columns
    bits = (52 - max(1, x.shape[1]).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs_of(x, bits)):
        for j, b in enumerate(limbs_of(c, bits)):
            out += (a @ b.T).astype(np.int64) << bits * (i + j)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of the nearest rows of ``c``, and its squared distance."""
    far = dot_products(x, c)
    far *= -2
    far += (c * c).sum(1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def _cut(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """A list column without nulls by row, part and position."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width).astype(np.int64)


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (array of int) of the rows whose vector has neither nulls nor components that aren't finite.

    All components are floored. Other columns go. A component has to be so small that no squared distance of two vectors exceeds
    int64 (about 2**27 for 64 components, after scaling); one that isn't fails the job, as cutting it would change distances.
    """
    kinds = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts])
            keep = np.repeat(good, ends - starts)
            sizes = (ends - starts)[good]
            whole = np.floor(x[keep] * SCALE)
            most = isqrt((2**63 - 1) // (4 * int(max(1, sizes.max(initial=1)))))
            if len(whole) and np.abs(whole).max() > min(most, 2**31 - 1):
                raise ValueError(f"a component exceeds {min(most, 2**31 - 1)} / {SCALE}: distances would exceed 64 bits")
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(whole.astype(np.int32)))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), vectors], names=["vec_id", "label", "vector"])

    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"{kinds.simpleString()[7:-1].replace(':', ' ')}, vector array<int>")


def _first(rows: DataFrame, entries: int, width: int) -> np.ndarray:
    """The vectors of the smallest keys, as they are ordered; equal keys by vector, null keys last. At most so many rows come to the driver."""
    keys = rows.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()  # ids first: what is sorted is narrow
    if len(keys) == entries and keys[-1][0] is not None:
        rows = rows.filter(F.col("vec_id") <= keys[-1][0])
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    return np.array([r[0] for r in found], np.int64).reshape(len(found), width)


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after so many rounds over quantised rows.

    A task adds up its own rows by part and entry; a sum and a count for each leave it. Spark adds those exactly, as decimals, and divides. The
    driver holds the codebooks alone: entries times components.
    """
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            parts, entries, width = c.shape
            sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                x = _cut(batch.column(0), parts, width)
                for a in range(0, len(x), ROWS):
                    for p in range(parts):
                        piece = x[a : a + ROWS, p]
                        at, _ = nearest(piece, c[p])
                        order = np.argsort(at, kind="stable")
                        used, begin, many = np.unique(at[order], return_index=True, return_counts=True)
                        sums[p, used] += np.add.reduceat(piece[order], begin, axis=0)
                        counts[p, used] += many
            p, e = np.nonzero(counts)
            if len(p) and width:
                cell = (((p * entries + e) * width)[:, None] + np.arange(width)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], width))], names=["cell", "total", "n"])

        cells = rows.select("vector").mapInArrow(run, "cell long, total long, n long")
        cells = cells.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        # floor of the quotient, for negative sums too; one row for each component of a codebook comes to the driver
        found = cells.selectExpr("cell", "(total - pmod(total, n)) div n AS value").toArrow()
        books = books.copy()
        books.reshape(-1)[found["cell"].to_numpy()] = found["value"].to_numpy()
        shared.unpersist()
    return books


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error`` (squared distance to what the code stands for), ``label_error`` (errors of all rows with the label) and ``codebooks_sha256``.

    Rows whose vector is null, or holds a null or a component that isn't finite, go. Codebooks begin as the parts of the vectors of the
    smallest keys (fewer entries where rows are fewer), ascending, null keys last, equal keys by vector. In each round every part goes to the
    nearest entry, the first of equals, and an entry becomes the floored mean of its parts; unused entries stay. Equal vectors have equal
    codes; repeated rows stay; null labels are one label; other columns go; no rows give none. Vectors of length 0 have code 00 in each
    part. Kept vectors of different lengths, or of one that doesn't divide into the parts, fail the job. ``codebooks_sha256`` is of the
    decimal components by part, entry and position, joined by commas.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits tell 256 entries apart")
    spark, shelf = df.sparkSession, Shelf()
    rows = shelf.put(quantised(df, key, vector, label), "vectors")
    least, most = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most or (most or 0) % parts:
        raise ValueError(f"vectors have lengths from {least} to {most}; they have to be equal and a multiple of {parts}")
    books = _first(rows, entries, most or 0)
    books = np.ascontiguousarray(books.reshape(len(books), parts, (most or 0) // parts).swapaxes(0, 1))
    books = train(rows, books, rounds) if books.size else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = _cut(batch.column(2), parts, c.shape[2])
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for a in range(0, len(x), ROWS):
                for p in range(parts):
                    at, far = nearest(x[a : a + ROWS, p], c[p])
                    codes[a : a + ROWS, p] = at
                    error[a : a + ROWS] += far
            text = codes.tobytes().hex()
            code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    fields = rows.select("vec_id", "label").schema.simpleString()[7:-1].replace(":", " ")
    coded = materialize(rows.mapInArrow(run, f"{fields}, code string, error long"), "codes")
    shelf.clear()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
