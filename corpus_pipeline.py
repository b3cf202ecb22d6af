"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing and BPE, a stage each.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on; all but the last keep the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.bpe import encode
from strandline.llm.common import Latest, fresh, table
from strandline.llm.minhash import near_groups
from strandline.llm.mixing import mix
from strandline.llm.q_bpe import vocabulary_path
from strandline.llm.rules import judge
from strandline.llm.simhash import duplicate_links
from strandline.llm.substrings import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """The documents under column names that no operator uses, those names, and the columns that bring the given names back."""
    names = {c: f"stage_in_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names, [F.col(n).alias(c) for c, n in names.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weakly supervised rules reject.

    Null and empty texts are rejected (too few words); equal rows are judged alike, also where ids are null or repeated; every column of the
    input stays as it is, whatever its name; an empty table gives an empty one.
    """
    rows, names, back = _hidden(docs)
    return judge(rows, text=names["text"]).filter("kept").select(*back)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates.

    Documents are linked by SimHash (fingerprints within 2 bits), and where they share four fifths of their 5-word shingles: copies with a
    few edited words are mostly farther apart than 2 bits, and a wider budget would make the trie join visit most pairs. A group is what
    links of both kinds connect, over all documents. Texts without words (null, empty) are one group; of rows with one id the one
    with the least text stays (nulls first; then by all columns); rows without an id stay, all of them; an empty table gives an empty one.
    """
    known = docs.select("doc_id", "text").filter("doc_id is not null")
    groups = near_groups(known, links=duplicate_links(known)).filter("node <> component").select(F.col("node").alias("doc_id"))
    again = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    rows = docs.join(groups, "doc_id", "left_anti")  # rows without an id match none, and stay
    one = F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias("row")
    chosen = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*")
    return rows.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(chosen.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that start in an earlier document; a document of which nothing is left goes.

    Changed texts get the words left, joined by one space, and their ``n_chars`` anew; all other values stay as they are, whatever the
    columns' names. Null and empty texts stay; rows of one id remove nothing from each other; a null id counts as the last; an empty table
    gives an empty one.
    """
    rows, names, back = _hidden(docs)
    found = remove_repeats(rows, key=names["doc_id"], text=names["text"], new_text="kept")
    changed = F.col("n_removed") > 0
    left = found.filter(~changed | (F.col("n_removed") < F.col("n_words")))
    out = {names["text"]: F.when(changed, F.col("kept")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        out[names["n_chars"]] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(names["n_chars"]))
    return left.withColumns(out).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: none, once or repeatedly.

    A null source is a source of its own; texts without words (null, empty) are taken once; rows without an id stay as they are; rows that
    share an id are taken as often as the most taken of them; an empty table gives an empty one.
    """
    (name,) = fresh(docs, "copies")
    known = docs.filter("doc_id is not null")
    copies = mix(known.select("doc_id", "source", "text")).groupBy("doc_id").agg(F.max("copies").alias(name)).filter(F.col(name) > 0)
    taken = known.join(copies, "doc_id").withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name))))
    return taken.select(*docs.columns).unionByName(docs.filter("doc_id is null").select(*docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, their number, and the digest of what they decode to.

    A null text is empty and gets no ids; repeated rows and null ids stay as they are; columns named like the new ones are replaced; an
    empty table gives an empty one.
    """
    return encode(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Fingerprints, posteriors and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored before the next reads it, and deleted once the next is stored."""
    docs, kept = table(spark, sf_dir, "documents"), Latest("stage")
    for _, stage in STAGES:
        docs = kept.put(stage(spark, docs, sf_dir))
    return docs
