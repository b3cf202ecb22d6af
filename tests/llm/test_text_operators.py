"""Substrings, tokens, chats, fingerprints and rules against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import bpe, chat, hashing, minhash, rules, simhash, substrings
from strandline.llm.q_bpe import vocabulary_path
from strandline.llm.registry import queries


def brute_substrings(rows, window=50):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    key = lambda k: float("inf") if k is None else k
    for k, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, float("inf")), key(k))
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(k):
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 30, 2000])
def test_substrings(docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", (block, block))
    monkeypatch.setattr(substrings, "RANGE_ANCHORS", (16, 16))
    monkeypatch.setattr(substrings, "RANGE_BYTES", (4000, 4000))
    got = substrings.remove_repeats(docs)
    assert {"fp", "lang", "source"} <= set(got.columns)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_substrings(rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_word_hashes_follow_split():
    text = "  a bb\tccc\x0b\n\nzz\x85é  a".encode()
    raw = np.frombuffer(text, np.uint8)
    starts, ends = hashing.words_of(raw)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    h = hashing.word_hashes(raw, starts, ends)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(set(text.split()))
    assert (np.concatenate(list(hashing.text_hashes([text, b"", text], most=3))) == np.concatenate([h, h])).all()


def thue_morse(steps, first):
    out = first
    for _ in range(steps):
        out += out.translate(bytes.maketrans(b"ab", b"ba"))
    return out


@pytest.mark.parametrize("steps", [3, 5, 6, 10, 12])
def test_words_that_polynomials_confuse(spark, steps):
    """Words of 8 to 4096 bytes on which polynomials modulo 2**64 agree for every odd base (from 1024 bytes on)."""
    one, other = thue_morse(steps, b"a"), thue_morse(steps, b"b")
    raw = np.frombuffer(one + b" " + other, np.uint8)
    for seed in (0, 1):
        h = hashing.word_hashes(raw, *hashing.words_of(raw), seed)
        assert h[0] != h[1]
    lead = [f"w{i}" for i in range(49)]
    rows = [(0, " ".join([*lead, one.decode()])), (1, " ".join([*lead, other.decode()])), (2, " ".join([*lead, other.decode(), "end"]))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_substrings(rows)


@pytest.mark.parametrize("window", [1, 2, 7, 64, 1024])
def test_windows_of_any_length(spark, window):
    """Sequences of two words on which pure polynomials agree from 1024 words on, and their repeats."""
    one, other = (" ".join(thue_morse(10, x).decode()) for x in (b"a", b"b"))
    rows = [(0, one), (1, other), (2, "x " + other + " y"), (3, one + " " + one), (4, "a b"), (5, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_substrings(rows, window)


@pytest.mark.parametrize("size", [3, 50, 512, 1024, 2048])
def test_rolling_tells_runs_apart(size):
    words = np.frombuffer(thue_morse(12, b"a"), np.uint8)
    h = np.array([0x1234567, 0x89ABCDEF], np.uint64)[words - ord("a")]
    for base in hashing.BASES:
        got = substrings.rolling(h, size, base)
        runs = {}
        for i, v in enumerate(got.tolist()):
            runs.setdefault(v, set()).add(words[i : i + size].tobytes())
        assert len(got) == len(words) - size + 1 and all(len(x) == 1 for x in runs.values())
        assert len(runs) == len({words[i : i + size].tobytes() for i in range(len(got))})


def test_ranges_stay_bounded():
    for total in (1 << 20, 1 << 36, 1 << 47):
        assert total / substrings._ranges(total, (8 << 20, 32 << 20)) <= 32 << 20
    assert substrings._ranges(1 << 34, (8 << 20, 32 << 20)) == 2048


def test_rice_code():
    draw = np.random.default_rng(0)
    for n in (1, 7, 1000):
        for most in (5, 1 << 22, 1 << 40):
            cells = np.sort(draw.integers(0, most, n))
            assert (substrings.unpack(substrings.pack(cells)) == cells).all()


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    got = bpe.round_trip(docs, vocabulary_path()).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    kept = bpe.encode(docs, vocabulary_path(), keep_text=True).filter("doc_id = 106").first()
    assert list(kept.ids) == library.encode(kept.text, add_special_tokens=False).ids and 50256 in kept.ids
    assert bpe.encode(empty, vocabulary_path()).count() == 0


def test_bpe_remembers_so_many_bytes(monkeypatch):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(vocabulary_path()), bpe.Encoder(bpe.load(vocabulary_path()))
    monkeypatch.setattr(bpe, "HELD_BYTES", 20_000)
    draw = np.random.default_rng(4)
    for _ in range(6):  # words of up to 3000 letters, and more short ones than are remembered
        texts = [" ".join("".join(draw.choice(list("abcxyz"), n)) for n in draw.integers(1, top, 40)) for top in (8, 8, 3000)]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode_batch(texts) == want
        assert max(map(len, encoder.known)) <= bpe.LONG_WORD
    assert sum(4 * len(w) + len(t) + bpe.ENTRY for w, t in encoder.known.items()) == encoder.held < 21_000


def test_bpe_compatibility_is_exact():
    from tokenizers import Tokenizer

    v, library = bpe.Vocabulary(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list("abehintérs"), draw.integers(1, 30))) for _ in range(2000)] + ["a" * n for n in range(1, 400, 37)]
    tokens, exact = v.encode_words([w.encode() for w in words])
    assert tokens == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert 0 < exact < len(words)


def test_chats_come_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    formatted = chat.format_chats(rows)
    back = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    turns = [(t.role, t.text) for t in back[0].turns]
    assert turns == [("system", "be\n"), ("user", "hi <|end|>"), ("user", ""), ("assistant", "[INST]\\ <\\s> </s> <|next|>"), ("assistant", ""), ("assistant", "bye")]
    assert [(t.role, t.text) for t in back[1].turns] == [("assistant", "a"), ("assistant", "b")]
    assert list(back[0].loss_texts) == ["[INST]\\ <\\s> </s> <|next|>", "", "bye"] and list(back[2].loss_texts) == []
    assert len(back[2].turns) == 2
    f = back[0].formatted
    assert f.count("<|begin|>") == 3 and f.count("<|end|>") == 3 and "</s>" not in f and "[INST]" not in f
    at = 0
    for m in back[0].loss_mask:  # the mask covers the string but for its last mark
        at += m.marks + m.chars
    assert f[at:] == "<|end|>"
    assert chat.format_chats(rows.filter("false")).count() == 0
    odd = {r.conv_id: r for r in queries()["op6_chat"](spark, sf_dir).collect()}[-1]
    assert odd.n_turns == 2 and odd.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_chats_of_odd_rows(spark):
    """Null conversations, turns and roles, clashing columns, a long text and a long conversation; a mask that doesn't fit is told."""
    from pyspark.sql import functions as F

    long = "word </s> " * 100_000
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (1, 0, "assistant", long), (1, 1, "assistant", "<|end|>"), *((2, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(2000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "loss_mask", "turns", "one", "blocks")})
    formatted = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    assert [(t.role, t.text) for t in back[None].turns] == [("", ""), ("user", "lost")] and list(back[None].loss_texts) == []
    assert list(back[1].loss_texts) == [long, "<|end|>"] and back[1].formatted.count(chat.BEGIN) == 1
    assert [t.text for t in back[2].turns] == [f"t{i}" for i in range(2000)] and list(back[2].loss_texts) == [f"t{i}" for i in range(2000) if i % 3]
    shifted = formatted.filter("conv_id = 2").withColumn("formatted", F.concat("formatted", F.lit("x")))
    with pytest.raises(Exception, match="doesn't fit"):
        chat.read_chats(shifted).collect()


def brute_fingerprint(text, words=3):
    import xxhash

    w = text.encode().translate(simhash.LOWER).split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if grams and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("subtree", [1 << 20, 4])
def test_simhash(docs, rows, empty, monkeypatch, subtree):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, subtree))
    got = simhash.near_duplicates(docs)
    prints = [brute_fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], prints[i], least.get(find(i))) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_walk(budget):
    draw = np.random.default_rng(budget)
    base = draw.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)]
    x = np.unique(np.concatenate([base, *near]))
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    got = [(a, b) for i, j in simhash._walk(x, x, 0, budget, True) for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in np.argwhere(d <= budget).tolist() if i < j}


@pytest.mark.parametrize("block", [1 << 30, 3000])
def test_minhash_edits(spark, sf_dir, empty, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", (block, block))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in minhash.fingerprint_edits(docs.repartition(3)).collect()}
    ordered = sorted((r.doc_id, r.text or "") for r in docs.collect())
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.encode().split())
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (i, text) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 4] + follower[: len(text) // 4]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(grams(text), grams(edited))) < 0.2
        assert abs(r.near_next - like(grams(text), grams(follower))) < 0.2
    same = {}
    for i, text in ordered:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert len(got) == len(ordered) and minhash.fingerprint_edits(empty).count() == 0


def test_minhash_odd_rows(docs, rows):
    got = minhash.fingerprint_edits(docs).collect()
    ordered = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    want = Counter((None if none else i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + ordered[(k + 1) % len(ordered)][2][: len(t) // 4]).encode()).hexdigest()) for k, (none, i, t) in enumerate(ordered))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_minhash_estimates():
    """Entries agree with probability equal to the Jaccard similarity: within four standard errors at known similarities."""
    hasher, draw = minhash.MinHasher(), np.random.default_rng(4)
    for like in (0.2, 0.5, 0.8, 0.95):
        off = []
        for _ in range(40):
            n = 1000
            both = round(n * like)
            x = draw.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            a, b = hasher.signature(x[:n]), hasher.signature(np.concatenate([x[:both], x[n:]]))
            off.append((minhash.digest(a) == minhash.digest(b)).mean() - both / (2 * n - both))
        assert abs(np.mean(off)) < 4 * (0.25 / 128 / 40) ** 0.5


def brute_statistics(text):
    w, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    w = [x.decode() for x in w]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules(docs, rows, empty):
    got = rules.judge(docs).collect()
    want = Counter((r[0], *brute_statistics(r[1] or "")) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.quality >= 0.5)
    assert not [r for r in got if r.doc_id == 107 and r.kept]
    assert rules.judge(empty).count() == 0


def planted_votes(spark, n=20_000, seed=1):
    """Counts of vote patterns of rules of known accuracy, and that accuracy."""
    draw = np.random.default_rng(seed)
    truth = np.array([[0.95, 0.2], [0.85, 0.1], [0.8, 0.3], [0.9, 0.05]])
    good = draw.random(n) < 0.7
    says = np.where(draw.random((n, 4)) < np.where(good[:, None], truth[:, 0], truth[:, 1]), 1, -1)
    says[draw.random((n, 4)) < [0.1, 0.6, 0.0, 0.3]] = 0  # a rule that mostly abstains is no worse for that
    counts = Counter(map(tuple, says.tolist()))
    return spark.createDataFrame([(*k, c) for k, c in counts.items()], "a int, b int, c int, d int, n long"), truth, counts


def test_rules_find_planted_accuracies(spark):
    patterns, truth, _ = planted_votes(spark)
    model = rules.fit(patterns, list("abcd"))
    assert model.moved < rules.TOLERANCE and abs(model.share - 0.7) < 0.03
    assert np.abs(np.array(model.rates) - truth).max() < 0.05


def test_no_step_lowers_the_likelihood(spark):
    patterns, _, counts = planted_votes(spark, 2000, 2)
    strength, right, share0 = rules.PRIOR_STRENGTH, rules.PRIOR_RIGHT, rules.PRIOR_GOOD

    def likelihood(m):
        total = strength * (share0 * np.log(m.share) + (1 - share0) * np.log(1 - m.share))
        for g, b in m.rates:
            total += strength * (right * np.log(g) + (1 - right) * np.log(1 - g) + (1 - right) * np.log(b) + right * np.log(1 - b))
        for votes, n in counts.items():
            good, bad = m.share, 1 - m.share
            for v, (g, b) in zip(votes, m.rates):
                good, bad = (good * g, bad * b) if v == 1 else (good * (1 - g), bad * (1 - b)) if v == -1 else (good, bad)
            total += n * np.log(good + bad)
        return total

    with pytest.warns(UserWarning):
        found = [likelihood(rules.fit(patterns, list("abcd"), steps)) for steps in (1, 2, 3, 5)]
    assert found == sorted(found) and found[0] < found[-1]


def brute_votes(s, lines, capitals):
    n, chars, symbols, dup, repeat = s
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    words, mean = max(1, n), chars / max(1, n)
    return (
        vote(n >= 100, n < 50), vote(3 <= mean <= 9, mean < 2 or mean > 16), vote(symbols / words < 0.05, symbols / words > 0.3),
        vote(capitals / max(1, chars) < 0.1, capitals / max(1, chars) > 0.4), vote(repeat / words < 0.1, repeat / words > 0.4), vote(dup / max(1, lines) < 0.05, dup / max(1, lines) > 0.3),
    )


def test_rules_posterior(docs, rows):
    texts = [r[1] or "" for r in rows]
    facts = [(brute_statistics(t), len([x for x in t.split("\n") if x.encode().split()]), sum("A" <= c <= "Z" for c in t)) for t in texts]
    v = np.array([brute_votes(*f) for f in facts])
    rates, share = [(rules.PRIOR_RIGHT, 1 - rules.PRIOR_RIGHT)] * v.shape[1], rules.PRIOR_GOOD
    odds = lambda: np.log(share / (1 - share)) + sum(np.where(v[:, j] == 1, np.log(g / b), np.where(v[:, j] == -1, np.log((1 - g) / (1 - b)), 0)) for j, (g, b) in enumerate(rates))
    ratio = lambda x, among, prior: (x.sum() + prior * rules.PRIOR_STRENGTH) / (among.sum() + rules.PRIOR_STRENGTH)
    for _ in range(rules.STEPS):
        p = 1 / (1 + np.exp(-odds()))
        before = np.array([share, *np.ravel(rates)])
        share = ratio(p, np.ones(len(p)), rules.PRIOR_GOOD)
        rates = [(ratio(p[v[:, j] == 1], p[v[:, j] != 0], rules.PRIOR_RIGHT), ratio((1 - p)[v[:, j] == 1], (1 - p)[v[:, j] != 0], 1 - rules.PRIOR_RIGHT)) for j in range(v.shape[1])]
        if np.abs(before - np.array([share, *np.ravel(rates)])).max() < rules.TOLERANCE:
            break
    want = 1 / (1 + np.exp(-odds()))
    got = rules.judge(docs).select("doc_id", "text", "quality").collect()
    by_text = {(r.doc_id, r.text): r.quality for r in got}
    assert max(abs(by_text[r[0], r[1]] - want[i]) for i, r in enumerate(rows)) < 1e-6
