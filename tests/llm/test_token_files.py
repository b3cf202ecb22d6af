"""Token sets against the tokenizers library, and codes against plain arrays."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import token_files
from strandline.llm.q_token_files import op11_token_files, tokenizer_path
from strandline.llm.token_files import Codes, encode_ids, read_documents, tokens_at, widths, write_tokens


def library(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4") for _, text in rows]


ARRAYS = [[], [0], [1], [2**32 - 1, 0], [5] * 600, list(range(3000)), [0] * 511 + [70000] * 3, [255, 256, 65535, 65536]]


@pytest.mark.parametrize("ids", [*ARRAYS, "random"])
def test_codes(ids):
    if ids == "random":
        draw = np.random.default_rng(1)
        ids = (2 ** draw.uniform(0, 32, 5000)).astype(np.uint32)
    ids = np.array(ids, np.uint32)
    body = encode_ids(ids)
    codes = Codes(body)
    assert len(codes) == len(ids) and (codes.all() == ids).all()
    at = np.random.default_rng(2).permutation(len(ids))
    assert (codes.take(at) == ids[at]).all() and len(codes.take(at[:0])) == 0
    with pytest.raises(IndexError):
        codes.take(np.array([len(ids)]))


def test_widths_are_the_cheapest():
    ids = np.array([1] * 50 + [300] * 20 + [40000] * 7, np.uint32)

    def bits(cut):
        total, left = 0, ids
        for k, w in enumerate(cut):
            total += len(left) * (w + (k + 1 < len(cut)))
            left = left >> w
            left = left[left > 0]
        return total

    def all_cuts(n):
        return [[n]] + [[first, *rest] for first in range(1, n) for rest in all_cuts(n - first)]

    assert sum(widths(ids)) == 16 and bits(widths(ids)) == min(bits(c) for c in all_cuts(16))
    assert len(encode_ids(ids)) < 4 * len(ids)


ODD = ["", " ", "Straße\u0301 e\u0301 \u0301x İI ΑΣ ς. \u00a0a\u2003b\x1cc\x85d\u3000e", "<|endoftext|>a <|StartOfText|> x<|startoftext|>\ty", "it's I'LL 12ab3 ...!? 日本語テキスト 🙂🙂", "A" * 300 + " " + "é" * 300, "e \u0301\u0323 \n\r\x0b\x0c k\u212a ﬁ ǅ"]


def test_words_alone_are_words_together(rows, monkeypatch):
    """The vocabulary drops white space, so that texts can be cut at ASCII blanks, whatever stands beside them."""
    monkeypatch.setattr(token_files, "STEP", 50)
    monkeypatch.setattr(token_files, "HELD_BYTES", 300)
    draw = random.Random(3)
    strange = "aAéÉ1'!<|>e\u0301\u0323\u0130Σς\ufb01\u01c5\u212a\u1100\u1161\u11a8日🙂\u00a0\u2003\x1c\x85\u0345\u200d \t\n"
    texts = ODD + [r[1] or "" for r in rows] + ["".join(draw.choices(strange, k=draw.randrange(1, 40))) for _ in range(500)]
    with open(tokenizer_path(), encoding="utf-8") as f:
        model = f.read()
    whole = [x.tobytes() for x in library([(0, t) for t in texts])]
    for cut in (True, False):
        got = list(token_files.Encoder(model, cut).encode([t.encode() for t in texts]))
        assert [x + b"\1\0\0\0" for x in got] == whole


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_token_set(docs, rows, empty, spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    write_tokens(docs, str(tmp_path / "a"), tokenizer_path())
    got = read_documents(spark, str(tmp_path / "a")).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [(r.doc_id is None, r.doc_id or 0) for r in ordered] == sorted((r[0] is None, r[0] or 0) for r in rows)
    want = sorted((str(r[0]), ids.tobytes()) for r, ids in zip(rows, library([r[:2] for r in rows])))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in ordered), "<u4")
    places = spark.range(0, len(whole) + 50, 7).select((F.col("id") - 5).alias("place")).union(spark.sql("SELECT null UNION ALL SELECT 2 UNION ALL SELECT 2"))
    assert sorted(map(tuple, tokens_at(places, str(tmp_path / "a")).collect())) == [(i, int(whole[i])) for i in range(2, len(whole), 7)]
    write_tokens(empty, str(tmp_path / "b"), tokenizer_path())
    assert read_documents(spark, str(tmp_path / "b")).count() == 0
    assert tokens_at(places, str(tmp_path / "b")).count() == 0


def test_query(spark, sf_dir):
    rows = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    ids = library(rows)
    starts = [0, *np.cumsum([len(x) for x in ids])[:-1].tolist()]
    want = [(k, s, len(x), zlib.crc32(x.tobytes())) for (k, _), s, x in zip(rows, starts, ids)]
    assert sorted(map(tuple, op11_token_files(spark, sf_dir).collect())) == want
