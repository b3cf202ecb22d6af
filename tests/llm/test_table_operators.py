"""Mixing, archive, classifier, sharding, components and the pipeline against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

import pytest

from strandline.llm import components, mixing, quality_model, sharding, warc
from strandline.llm.common import ordered_positions, scratch
from strandline.llm.registry import queries


def test_ordered_positions(spark):
    df = spark.range(500).selectExpr("id", "pmod(id * 7919, 501) as k", "id % 5 as w").repartition(4)
    got = {r.id: (r.pos, r.before) for r in ordered_positions(df, ["k"], "w").collect()}
    before = 0
    for place, (k, i) in enumerate(sorted((i * 7919 % 501, i) for i in range(500))):
        assert got[i] == (place, before)
        before += i % 5


def brute_targets(sizes, weights=mixing.WEIGHTS, cap=mixing.CAP):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        out = {s: float(cap * sizes[s]) if s in held else weight[s] * left / free for s in names}
        above = {s for s in names if s not in held and out[s] > cap * sizes[s]}
        if not above:
            return out
        held |= above


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = lambda r: len((r[1] or "").encode().split())
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += size(r)
    want = brute_targets(by_source)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r)) for r in rows)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.source_size == by_source[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest[s] / 2, 0.02 * t), (s, taken[s], t)
    for s, t in want.items():  # the dual's solution by bisection
        sizes = np.array([size(r) for r in rows if r[3] == s], float)
        if not sizes.sum() or t >= 3 * sizes.sum():
            continue
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * np.minimum(3, np.exp(np.minimum(mid * sizes / sizes.mean(), 5)))).sum() < t else (low, mid)
        rates = {r.size: r.rate for r in got if r.source == s}
        for n in set(sizes):
            assert abs(rates[n] - min(3, np.exp(min(low * n / sizes.mean(), 5)))) < 0.01
    again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_says_that_it_was_stopped(docs, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.warns(UserWarning, match="not balanced"):
        mixing.mix(docs)


def test_mixing_splits_hot_cells(spark):
    rows = [(i, "w " * 10, None, "hot", 0) for i in range(9000)] + [(9000 + i, "w " * 10, None, "other", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, weights=(1.0, 1.0)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 for r in got) and len(got) == 2


def test_archive(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    path = scratch(spark, "archive-test")
    warc.write_archive(pages, path)
    records = warc.read_warc(spark, f"{path}/records").collect()
    kinds = Counter(r.record_type for r in records)
    assert kinds.pop("warcinfo") >= 1 and kinds == {"response": 6, "revisit": 1}
    by_page = {int(r.record_id.split(":")[2]): r for r in records if r.record_type != "warcinfo"}
    assert by_page[1].record_type == "revisit" and by_page[1].refers_to == by_page[3].record_id and len({r.record_id for r in records}) == len(records)
    for r in warc.restore(spark, path).collect():
        payload = (rows[r.record_id].html or "").encode()
        assert bytes(r.payload) == payload and r.payload_bytes == len(payload) and r.payload_sha1 == hashlib.sha1(payload).hexdigest()
        head, http = r.header.split("\r\n\r\n")[:2]
        assert f"Content-Length: {len(http) + 4 + len(payload)}" in head and http.endswith(f"Content-Length: {len(payload)}")
        assert all(":" in line for line in head.split("\r\n")[1:])
    got = {r.page_id: (r.record_type, r.refers_to) for r in queries()["op2_warc"](spark, sf_dir).collect()}
    assert got == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    odd = spark.createDataFrame([(None, None, "y" * 2000, 1), (8, None, "y" * 2000, 1), (8, None, "y" * 2000, 1)], "page_id long, url string, html string, sha256 int")
    path = scratch(spark, "archive-odd")
    warc.write_archive(odd, path)
    assert Counter((r.record_id, r.record_type) for r in warc.restore(spark, path).collect()) == {(None, "revisit"): 1, (8, "response"): 2}
    path = scratch(spark, "archive-empty")
    warc.write_archive(odd.filter("false"), path)
    assert warc.restore(spark, path).count() == 0


def test_archive_files(spark):
    """Every file has the standard's name, begins with a warcinfo record, and holds a gzip member for each record; files are cut by bytes; a key that repeats has different ids."""
    import gzip
    import random
    import zlib
    from pathlib import Path

    draw = random.Random(3)
    long = "".join(draw.choices("abcdefghij ", k=1 << 20)) * 17
    rows = [(i % 30, f"http://host/{i}", "small" if i % 3 else f"{i} page " * 9000) for i in range(60)] + [(100, "http://long", long), (101, "http://long", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch(spark, "archive-files")
    warc.write_archive(pages, path, file_bytes=200_000)
    files = sorted(Path(path.removeprefix("file://"), "records").glob("part-*"))
    assert len(files) > 8 and all(f.name.endswith(".warc.gz") for f in files)
    ids, sizes = [], []
    for file in files:
        left, records = file.read_bytes(), []
        assert gzip.decompress(left) == b"".join(warc._unzipped(left))
        while left:
            unzip = zlib.decompressobj(31)
            record = unzip.decompress(left)
            assert unzip.eof
            left = unzip.unused_data
            if record:
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and len(list(warc._records(iter([record])))) == 1
                records.append(record)
        assert b"WARC-Type: warcinfo\r\n" in records[0] and not any(b"WARC-Type: warcinfo" in r for r in records[1:])
        ids += [r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in records]
        sizes.append((sum(map(len, records[1:])), len(records) - 1))
    assert len(set(ids)) == len(ids) == len(rows) + len(files)
    assert all(size <= 200_000 or number == 1 for size, number in sizes)
    assert max(size for size, _ in sizes) > 1 << 24
    want = sorted((i, hashlib.sha256(html.encode()).hexdigest(), len(html)) for i, _, html in rows)
    assert sorted((r.record_id, r.sha256, r.payload_bytes) for r in warc.restore(spark, path).select("record_id", "sha256", "payload_bytes").collect()) == want


def test_archive_reads_gzip_members():
    import gzip

    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    content = gzip.compress(record(b"one\r\n\r\n")) + gzip.compress(record(b"two"))
    assert [b for _, b in warc._records(warc._unzipped(content, 7))] == [b"one\r\n\r\n", b"two"]


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op3_quality_model"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    good = np.array([got[i].score for i, q in labels.items() if got[i].held_out and q == 1])
    bad = np.array([got[i].score for i, q in labels.items() if got[i].held_out and q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.7).mean() > 0.95


def test_quality_model_rows(spark, docs, rows, empty, sf_dir):
    from pyspark.sql import functions as F

    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    got = quality_model.score(docs, model).select("doc_id", "score", "predicted").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(empty, model).count() == 0
    none = quality_model.fit(empty, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    assert set(none.score(np.zeros((3, len(quality_model.FEATURES))))) == {0.5}


def test_a_repeated_id_counts_once_in_the_sample(spark, docs, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    labels, seen = spark.read.parquet(f"{sf_dir}/labels.parquet"), []
    monkeypatch.setattr(quality_model, "train", lambda x, y: seen.append((x.tolist(), y.tolist())))
    one = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    quality_model.fit(one, labels, F.lit(True))
    quality_model.fit(one.unionByName(one).unionByName(one.withColumn("text", F.concat("text", F.lit(" more")))).repartition(3), labels, F.lit(True))
    assert seen[0] == seen[1] and seen[0][1]


def test_trees_walk():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(400, 5)), draw.integers(0, 2, 400).astype(float)
    t = quality_model.train(x, y, trees=7, depth=3)
    for row, s in zip(x[:50], t.score(x[:50])):
        total = t.bias
        for f, c, v in zip(t.feature, t.threshold, t.value):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > c[k] else 1)
            total += v[k - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def brute_features(text):
    """The 23 statistics by loops over bytes, words and lines."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
    if not words:
        return [np.log1p(len(raw))] + [0.0] * 22
    n, size, total = len(words), len(raw), lambda test: sum(map(test, raw))
    blanks = total(lambda b: b in b" \t\n\v\f\r")
    letters = max(1, size - blanks)
    pairs = [(words[i], words[i + 1]) for i in range(n - 1)]
    entropy = -sum(k / size * np.log2(k / size) for k in Counter(raw).values())
    return [
        np.log1p(size), np.log1p(n), letters / n, np.log1p(max(len(w) for w in words)),
        total(lambda b: chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters, total(lambda b: chr(b) in "0123456789") / letters, blanks / size, total(lambda b: chr(b) in "#*$%&|<>") / n,
        total(lambda b: chr(b) in ".,;:?") / n, raw.count(b"!") / n, raw.count(b"|") / n, total(lambda b: b > 127) / letters, entropy,
        len(set(words)) / n**0.9, max(Counter(words).values()) / n, len(set(pairs)) / len(pairs) if pairs else 1.0, sum(a == b for a, b in pairs) / max(1, len(pairs)),
        sum(chr(w[-1]) in "#*$%&|<>" for w in words) / n, sum(w[:1].isupper() for w in words) / n,
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


def test_features_equal_brute_force(rows):
    texts = {r[1] or "" for r in rows} | {"", " \n\t", "a", "A!", "x | y\n\nx | y\nZ. \n", "é 日本 #a a# 7", "same same same"}
    for text in texts:
        assert np.allclose(quality_model.features(text), brute_features(text), rtol=1e-12, atol=1e-12), text[:80]


def test_a_stump_is_the_best_of_all_cuts():
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(300, 4)), draw.integers(0, 2, 300).astype(float)
    x[:, 2] += y
    t = quality_model.train(x, y, trees=1, depth=1, bins=16)
    p = 1 / (1 + np.exp(-t.bias))
    best, at = -1.0, None
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, f] <= cut
            gain = sum((y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + 1) for s in (left, ~left)) - (y - p).sum() ** 2 / (300 * p * (1 - p) + 1)
            if gain > best + 1e-12:
                best, at = gain, (f, cut)
    assert (t.feature[0, 0], t.threshold[0, 0]) == at
    left = x[:, at[0]] <= at[1]
    assert np.allclose(t.value[0], [0.1 * (y[s] - p).sum() / (s.sum() * p * (1 - p) + 1) for s in (left, ~left)])


def test_shards_have_near_equal_bytes(spark):
    """The law ``bytes``: a shard misses its share by less than the largest group, here with copies of some texts and very unlike sizes."""
    draw = np.random.default_rng(6)
    texts = ["w" * int(n) for n in draw.pareto(1.5, 700) * 40] + ["copy " * 30] * 25 + [None, ""] * 3
    langs, sources = draw.choice(["de", "en", "fr"], len(texts), p=[0.1, 0.8, 0.1]).tolist(), draw.integers(0, 9, len(texts)).tolist()
    df = spark.createDataFrame([(i, t, a, f"s{b}") for i, (t, a, b) in enumerate(zip(texts, langs, sources))], "doc_id long, text string, lang string, source string")
    got = sharding.assign(df, shards=6).collect()
    shares, groups = Counter(), Counter()
    for r in got:
        shares[r.shard] += r.size
        groups[texts[r.doc_id] or ""] += r.size
    total, largest = sum(shares.values()), max(groups.values())
    assert largest * 6 < total and set(shares) == set(range(6))
    assert all(abs(s - total / 6) < largest for s in shares.values())


def test_shards_are_written_by_slot(docs, spark):
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assigned = sharding.assign(one, shards=4)
    path = scratch(spark, "shards-test")
    sharding.write_shards(one, assigned, path)
    want = {r.doc_id: (r.shard, r.slot) for r in assigned.collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in spark.read.parquet(path).collect()} == want and want


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    total, largest = sum(r.size for r in got), max(Counter((r.text_crc32, r.size) for r in got).items(), key=lambda g: g[0][1] * g[1])
    share = Counter()
    for r in got:
        share[r.shard] += r.size
    big = largest[0][1] * largest[1]
    if big > total / 4:  # it has a shard of its own
        assert big in share.values()
    assert sharding.assign(empty).count() == 0


def test_hilbert_curve():
    for n, bits in ((2, 3), (3, 4), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        h = sharding.hilbert_index(cells, bits)
        assert sorted(h) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[h.argsort()], axis=0)).sum(1) == 1).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 3), (20, 21), (21, 22), (22, 20), (2, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in (1, 2, 3, 4)} | {i: 7 for i in (7, 8, 9)} | {i: 20 for i in (20, 21, 22)} | {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _warc_file(members, size=600):
    record = lambda i: (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {size}\r\n\r\n" + (f"{i:09d}" * size)[:size] + "\r\n\r\n").encode()
    return [record(i) for i in range(members)]


def test_reading_warc_is_linear():
    """20 000 records, as gzip members and plain, take seconds; every record comes back; damaged files are told."""
    import gzip
    import time

    from strandline.llm import warc

    records = _warc_file(20_000)
    for content in (b"".join(map(gzip.compress, records)), b"".join(records), gzip.compress(b"".join(records))):
        start = time.time()
        got = [(head, block) for head, block in warc._records(warc._unzipped(content))]
        assert len(got) == 20_000 and time.time() - start < 30
        assert all(block == r[-604:-4] for (_, block), r in zip(got, records))
    long = _warc_file(3, 5_000_000)
    assert [len(b) for _, b in warc._records(warc._unzipped(b"".join(map(gzip.compress, long))))] == [5_000_000] * 3
    for bad in (records[0][:100], b"no record at all", gzip.compress(records[0])[:-20]):
        with pytest.raises(ValueError):
            list(warc._records(warc._unzipped(bad)))
    assert list(warc._records(warc._unzipped(b""))) == []
