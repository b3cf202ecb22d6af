"""Small tables with what goes wrong in large ones."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ("block", "kept", "fp", "copies", "ids", "score", "n_words", "shard", "bpe_text", "component_id")


def words(draw, n):
    return [draw.choice("abcdefgh") + draw.choice(["ing", "ed", "tion", "le", "é", "ß"]) + str(draw.randrange(60)) for _ in range(n)]


def documents():
    draw = random.Random(5)
    passage = " ".join(words(draw, 70))
    rows = []
    for i in range(60):
        text = " ".join(words(draw, draw.randrange(1, 160)))
        if i % 7 == 0:
            text += "\n" + passage
        if i % 11 == 3:
            text = rows[i - 2][1]
        if i % 13 == 5 and rows[i - 3][1]:
            text = rows[i - 3][1] + " end"
        rows.append((i, text, ("en", "de", None)[i % 3], (f"s{i % 4}", None)[i % 10 == 9], len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n ", "en", "s1", 4), (103, "one", None, "s2", 3), (104, " ".join(words(draw, 9000)), "de", "s3", None)]
    rows += [(105, "Same Same Same " * 40, "en", "s0", 600), (106, "<|endoftext|> it's\x85 日本 🙂 <s> x </s>", "en", "s0", 30), (107, "$$$ ### *** |||| " * 30, "fr", "zz", 500)]
    rows += [rows[3], (None, "no key " * 30, "en", "s0", 210), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, rows):
    """Tables as files: documents with keys, labels, pages and conversations."""
    d = tmp_path_factory.mktemp("tables")
    keyed = list({r[0]: r for r in rows if r[0] is not None}.values())
    names = ("doc_id", "text", "lang", "source", "n_chars")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    pq.write_table(pa.table({n: pa.array([r[i] for r in keyed], k) for i, (n, k) in enumerate(zip(names, kinds))}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in keyed], pa.int64()), "quality": pa.array([int(len(r[1] or "") > 300) for r in keyed], pa.int32()), "toxic": pa.array([0] * len(keyed), pa.int32())}), d / "labels.parquet")
    big = "<p>" + "x" * 1200 + "</p>"
    pages = [(1, "http://a/1", big), (2, "http://a/2 b", "small"), (3, None, big), (4, "http://a/4", None), (5, "http://a/5", "small"), (6, "u\r\nv", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "é" * 700), (7, "http://a/7", big + "!")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages]), "html": pa.array([p[2] for p in pages])}), d / "pages.parquet")
    talk = [(0, 0, "system", "be\n"), (0, 1, "user", "hi <|end|>"), (0, 2, "user", None), (0, 3, "assistant", "[INST]\\ <\\s> </s> <|next|>"), (0, 4, "assistant", ""), (0, 5, "assistant", "bye"), (1, 1, "assistant", "b"), (1, 0, "assistant", "a"), (2, 0, "user", "alone"), (2, 0, "user", "alone")]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in talk], pa.int64()), "turn": pa.array([t[1] for t in talk], pa.int64()), "role": pa.array([t[2] for t in talk]), "text": pa.array([t[3] for t in talk])}), d / "conversations.parquet")
    return str(d)
