"""Exact product quantisation against whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandline.llm import vector_codes
from strandline.llm.vector_codes import dot_products, encode, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = [best(x[p], books[p])[1] for x in cut]
            for e in set(near):
                mine = [x[p] for x, n in zip(cut, near) if n == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    out = []
    for (k, _, label), x in zip(kept, cut):
        found = [best(x[p], books[p]) for p in range(parts)]
        out.append((k, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted(((k, code, e, total[label], digest) for k, label, code, e in out), key=str)


def vectors(n, width, spread, seed=3):
    draw = random.Random(seed)
    centres = [[float(np.float32(draw.uniform(-spread, spread))) for _ in range(width)] for _ in range(5)]
    return [(i, [float(np.float32(c + draw.gauss(0, spread / 9))) for c in draw.choice(centres)], draw.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.5, 3000.0])
def test_codes(spark, spread):
    rows = vectors(90, 8, spread)
    rows += [rows[5], (rows[6][0], rows[7][1], 2), (None, rows[8][1], None), (500, rows[9][1], 0)]  # repeated rows, a repeated key, no key, equal vectors
    rows += [(501, None, 0), (502, [0.0, None] + [1.0] * 6, 0), (503, [float("nan")] * 8, 0), (504, [float("inf")] + [0.0] * 7, None), (505, [-0.0001] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("code", "vector", "error", "cell", "_label"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    got = encode(df, entries=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, entries=16, rounds=3)


def test_fewer_rows_than_entries_and_none(spark):
    rows = vectors(3, 8, 1.0)
    assert sorted(map(tuple, encode(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert encode(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    (only,) = encode(spark.createDataFrame([(1, [], None)], SCHEMA)).collect()
    assert (only.code, only.error, only.label_error) == ("00000000", 0, 0)


def test_what_cannot_be_exact_fails(spark):
    with pytest.raises(Exception, match="lengths"):
        encode(spark.createDataFrame([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], SCHEMA))
    with pytest.raises(Exception, match="64 bits"):
        encode(spark.createDataFrame([(1, [1e9] * 4, 0)], SCHEMA)).collect()


@pytest.mark.parametrize("most", [1 << 4, 1 << 20, 1 << 26])
def test_limbs(most):
    draw = np.random.default_rng(2)
    x, c = draw.integers(-most, most, (50, 16)), draw.integers(-most, most, (9, 16))
    x[0], x[1], c[0], c[1], c[5] = most, -most, most, -most, c[4]
    want = [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in c] for a in x]
    assert dot_products(x, c).tolist() == want
    assert dot_products(x * 0 - 1, c).tolist() == [[-int(b.sum()) for b in c]] * 50
    far = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    at, error = nearest(x, c)
    assert at.tolist() == [row.index(min(row)) for row in far] and error.tolist() == [min(row) for row in far]


def test_limbs_stay_below_53_bits():
    for columns in (1, 16, 192, 4096):
        bits = (52 - columns.bit_length()) // 2
        assert columns * 2 ** (2 * bits) <= 2**53
    assert len(vector_codes.limbs_of(np.array([[1 << 27, -1]]), 23)) == 2
