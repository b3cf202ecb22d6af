"""The corpus pipeline, stage by stage, against what each operator's brute force says."""

from collections import Counter

from test_text_operators import brute_statistics, brute_substrings

import corpus_pipeline
from strandline.llm.mixing import mix
from strandline.llm.simhash import near_duplicates


def test_stages(spark, docs, rows, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "substring_dedup", "mixing", "bpe"]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "block")
    good = corpus_pipeline.quality_rules(spark, plain, sf_dir)
    assert good.columns == plain.columns
    for r in good.collect():
        n, _, _, _, repeat = brute_statistics(r.text or "")
        assert n >= 50 and 100 * repeat <= 50 * n
    kept = corpus_pipeline.simhash_dedup(spark, plain, sf_dir)
    groups = {r.doc_id: r.component_id for r in near_duplicates(plain).collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text or "" for r in plain.collect() if r.doc_id is not None}
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.encode().split())
    like = lambda a, b: len(grams(texts[a]) & grams(texts[b])) / max(1, len(grams(texts[a]) | grams(texts[b])))
    stay, heads = [r.doc_id for r in kept.collect() if r.doc_id is not None], set(groups.values())
    assert len(stay) == len(set(stay)) and set(stay) <= heads
    assert not [(a, b) for a in stay for b in stay if a < b and like(a, b) >= 0.8]
    # the hand-made copies with one more word are gone
    edited = [i for i, t in texts.items() if t.endswith(" end") and len(t.split()) > 60 and texts.get(i - 3) == t[:-4]]
    assert edited and not set(edited) & set(stay)
    cut = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, kept, sf_dir).collect()}
    left = [(r.doc_id, r.text) for r in kept.collect()]
    for (i, n, gone, text), _ in brute_substrings(left).items():
        if gone and gone == n:
            assert i not in cut
        elif gone:
            assert cut[i] == text
    mixed = corpus_pipeline.mixing(spark, kept, sf_dir)
    want = {r.doc_id: r.copies for r in mix(kept.filter("doc_id is not null")).collect()}
    assert mixed.columns == kept.columns
    assert Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None) == Counter({i: c for i, c in want.items() if c})


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "ids", "n_tokens", "decoded_sha256"} <= set(out.columns) and "text" not in out.columns
    assert all(len(r.ids) == r.n_tokens for r in out.collect()) and out.count() > 0


def test_columns_and_rows_that_clash(spark, docs, sf_dir):
    """Input columns named like an operator's own come back unchanged; of rows with one id a fixed one stays."""
    from pyspark.sql import functions as F

    new = {c: F.lit(f"own {c}") for c in ("quality", "kept", "n_words", "n_removed", "n_symbols", "base_failed", "copies", "fp", "component_id", "size", "taken", "node")}
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns(new)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        got = out.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in new), name
    words = [" ".join(f"{w}{k}" for w in range(60)) for k in "abc"]
    rows = [(1, words[1], "x"), (1, words[0], "y"), (1, words[0], "x"), (2, words[2], "z"), (None, words[2], "z"), (None, words[2], "z")]
    repeated = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([(1, words[0], "x"), (2, words[2], "z"), (None, words[2], "z"), (None, words[2], "z")], key=str)
    for parts in (1, 4):
        assert sorted(map(tuple, corpus_pipeline.simhash_dedup(spark, repeated.repartition(parts), sf_dir).collect()), key=str) == want


def test_empty_tables_and_nulls(spark, empty, sf_dir):
    nothing = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, None)], empty.schema)
    kept = {"quality_rules": 0, "simhash_dedup": 2, "substring_dedup": 3, "mixing": 3, "bpe": 3}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        assert stage(spark, nothing, sf_dir).count() == kept[name], name
