"""The pipeline's near-duplicate stage against the exact Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline
from strandline.llm import minhash


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def like(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(draw, words, places):
    out = list(words)
    for at in places:
        out[at] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def stay(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}


def groups(texts, least=0.8):
    """The smallest id of each document's component, pair by pair."""
    of = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and of[a] != of[b] and like(texts[a], texts[b]) >= least:
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return of


def family(draw, copies):
    """A text, and copies of it that are 0.8 or more like it but less than that like each other."""
    base = [f"w{draw.randrange(10**9)}" for _ in range(400)]
    return " ".join(base), [edited(draw, base, draw.sample(range(10, 390), 7)) for _ in range(copies)]


def test_family_with_its_base_anywhere(spark):
    for at in (0, 60, 120):
        draw = random.Random(at)
        base, copies = family(draw, 120)
        texts = dict(enumerate([*copies[:at], base, *copies[at:]]))
        assert all(like(base, c) >= 0.8 for c in copies) and sum(like(copies[0], c) >= 0.8 for c in copies[1:]) < 10
        assert stay(spark, texts) == {0}


def test_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPLIT", 7)
    draw = random.Random(2)
    base, copies = family(draw, 80)
    other, more = family(draw, 40)
    texts = dict(enumerate([*copies[:40], *more[:20], base, other, *copies[40:], *more[20:]]))
    found = {r.node: r.component for r in minhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert found == groups(texts)


def test_strangers_in_a_large_bucket(spark, monkeypatch):
    """A family of near copies that is one component, and strangers in its buckets: rows of the family are sent once for each piece of strangers."""
    monkeypatch.setattr(minhash, "SPLIT", 5)
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**9)}" for _ in range(400)]
    copies = [edited(draw, base, draw.sample(range(10, 390), 3)) for _ in range(60)]
    # half of the words are the family's: some bands are shared, the similarity is below 0.8
    strangers = [" ".join(base[:300] + [f"x{draw.randrange(10**9)}" for _ in range(100)]) for _ in range(12)]
    twin = strangers[4].split()
    strangers.append(edited(draw, twin, draw.sample(range(10, 390), 2)))
    texts = dict(enumerate([strangers[0], *copies[:30], *strangers[1:9], *copies[30:], *strangers[9:]]))
    found = {r.node: r.component for r in minhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    want = groups(texts)
    assert {i: found.get(i, i) for i in texts} == want and len(set(want.values())) > 10


def test_members_of_simhash_groups_link_too(spark):
    """A copy of a member of a SimHash group that is not its smallest id goes with the group."""
    base = " ".join(["word"] * 3000)
    texts = {1: base + " x1 x2 x3", 2: base + " y1 y2 y3 y4 y5 y6", 3: base + " y1 y2 y3 y4 y5 y6 y7"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from strandline.llm.simhash import near_duplicates

    of = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert of[2] == 1 and like(texts[1], texts[3]) < 0.8 <= like(texts[2], texts[3])
    assert stay(spark, texts) == {1}


def test_four_fifths_on_both_sides(spark):
    """Pairs at 0.80 to 0.83 go, pairs at 0.77 to just below 0.8 stay: the shingle sets decide, not an estimate of theirs."""
    from strandline.llm.simhash import fingerprint

    draw, texts, gone, at = random.Random(9), {}, set(), [0, 0]
    while min(at) < 30:
        base = [f"w{draw.randrange(10**9)}" for _ in range(300)]
        copy = edited(draw, base, draw.sample(range(300), draw.randrange(5, 10)))
        near = like(" ".join(base), copy)
        apart = (fingerprint(" ".join(base)) ^ fingerprint(copy)).bit_count() > 2
        if apart and 0.77 <= near <= 0.83 and at[near >= 0.8] < 30:
            at[near >= 0.8] += 1
            texts |= {len(texts): " ".join(base), len(texts) + 1: copy}
            gone |= {len(texts) - 1} if near >= 0.8 else set()
    assert stay(spark, texts) == set(texts) - gone


def test_recall_of_known_queries(spark):
    """Documents whose id is divisible by 20, against all rows of sf0.01: every partner at 0.8 or more is in their group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: grams(r.text or "") if (r.text or "").split() else set() for r in docs.collect()}
    of = {r.node: r.component for r in minhash.near_groups(docs).collect()}
    want = [(q, i) for q in sets if q % 20 == 0 and sets[q] for i in sets if i != q and len(sets[q] & sets[i]) >= 0.8 * len(sets[q] | sets[i])]
    found = [(q, i) for q, i in want if of.get(q, q) == of.get(i, i)]
    assert want and len(found) / len(want) >= 0.9


def test_nothing_to_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "a b c d e f"), (3, "g h i j k l m")], "doc_id long, text string")
    assert minhash.near_groups(docs).count() == 0 and minhash.near_groups(docs.filter("false")).count() == 0
