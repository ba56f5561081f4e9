"""Cases in which operators once did less than the whole job."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.llm import bigru_langid, line_dedup, pii_surrogates, simhash_trie

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n_words", [6, 8, 15, 30, 120])
def test_lines_with_one_changed_letter_are_linked(spark, n_words):
    rnd = random.Random(n_words)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    rows = []
    for k in range(40):
        line = [word() for _ in range(n_words)]
        at = rnd.choice([i for i, w in enumerate(line) if len(w) >= 4] or [0])
        other = [*line[:at], "z" + line[at][1:], *line[at + 1 :]]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    found = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect() if r.n_removed}
    assert found == {2 * k + 1 for k in range(40)}


def test_short_lines_and_lines_without_spaces(spark):
    rows = [(1, "Read more\n今日は天気がいいですね散歩に行きましょう\n---\n\nx"), (2, "read MORE!\n今日は天気がいいですね散歩に行きましょう\n---\n\ny"), (3, "今日は天気がいいですよ散歩に行きましょう\nX")]
    found = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: [], 2: [0, 1], 3: [0, 1]}


def test_secrets_without_a_digit(spark):
    secrets = ["sk-" + "aBcDeFgHiJ" * 3, "ghp_" + "abcdefghiJKL" * 3, "ghr_" + "abcdefghiJKL" * 3, "AKIA" + "ABCDEFGH" * 2, "abcdef" * 6]
    df = spark.createDataFrame([(k, f"key {x} here") for k, x in enumerate(secrets)], SCHEMA)
    found = {r.doc_id: r for r in pii_surrogates.surrogate_documents(df).collect()}
    assert all(found[k].n_entities == 1 and x not in found[k].text for k, x in enumerate(secrets))


def test_surrogates_of_a_form_whose_values_are_all_taken(spark):
    abc = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{a}@{b}.co" for a in abc for b in abc] + [f"{i // 1000}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}" for i in range(10000)] + [f"+{i // 10000} {i // 100 % 100:02d} {i % 100:02d}" for i in range(10000, 20000)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = [r.text for r in pii_surrogates.surrogate_documents(rows).collect()]
    assert len(found) == len(set(found)) == len(texts) and not set(found) & set(texts)
    df = spark.createDataFrame([(x,) for x in found], "text string")
    assert df.where(~F.col("text").rlike("^(?:" + pii_surrogates.ANY + ")$")).count() == 0


def test_near_copies_without_ids_leave_one(spark):
    rnd = random.Random(1)
    words = [f"word{rnd.randrange(10**6)}" for _ in range(3000)]
    texts = {" ".join([*words, f"end{k}"]) for k in range(40)}
    fps = {t: int.from_bytes(simhash_trie.fingerprint(t), "big") for t in texts}
    a = max(texts)
    b = next(t for t in sorted(texts) if 0 < (fps[t] ^ fps[a]).bit_count() <= simhash_trie.BUDGET)
    df = spark.createDataFrame([(None, a), (None, b), (1, "something else"), (1, "of the same id and far away from it")], SCHEMA)
    kept = Counter(r.doc_id for r in simhash_trie.keep_one(df).collect())
    assert kept == {None: 1, 1: 2}


def test_rare_languages_are_learned(spark):
    rows = [(i, "kako tona " * 3, "aa") for i in range(3000)] + [(5000 + i, "schung verein " * 3, "bb") for i in range(10)] + [(5000, "schung", "bb")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert bigru_langid.train(df, sample_docs=60).langs == ["aa", "bb"]
    for sizes in ({"a": 10**9, "b": 3, "c": 1}, {"a": 5, "b": 4}, {f"l{k}": 7 for k in range(100)}):
        dealt = bigru_langid.quotas(sizes, 200)
        assert sum(dealt.values()) <= 200 and all(0 < q <= sizes[x] for x, q in dealt.items())


def test_prefixes_of_many_near_copies_are_split(spark):
    rng = np.random.default_rng(5)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 52, (n, len(x)), dtype=np.uint64))
    near = np.full(1500, 0x123456789ABCDEF0, np.uint64)
    fps = np.unique(np.concatenate([flip(near, 5), flip(near, 2), rng.integers(0, 1 << 64, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    leaves = simhash_trie.leaves_of(df, deep=200)
    assert sum(leaves.values()) == len(fps) and max(leaves.values()) <= 200 and max(d for d, _ in leaves) > simhash_trie.TOP_BITS
    in_pair = Counter()
    for depth, prefix, pair, right in simhash_trie.leaf_pairs(leaves, simhash_trie.TOP_BITS, 100, 200):
        in_pair[pair, right] += leaves[depth, prefix]
    assert max(in_pair.values()) <= 200
    found = {(r.a, r.b) for r in simhash_trie.links(df, subtree=100, deep=200).collect()}
    index = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    groups = lambda pairs: simhash_trie.forest(len(fps), [tuple(np.array(sorted(pairs)).T)]).tolist()
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert groups({(index[a], index[b]) for a, b in found}) == groups({(int(i), int(j)) for i, j in zip(*np.nonzero(close))})


def test_long_texts_with_and_without_entities(spark):
    n = 100_000
    texts = ["x@" + "a." * n + "com", "a" * n * 10, "1" * n * 10, "1-" * n, "+1" + " 22" * n, "A1" * n, "Mr. " + "X" * n, "x" * n + "@y.com", " ".join(["bob@mail.org"] * 5000), "(" * n, "1.2." * n, "sk-" * n]
    found = {r.doc_id: r for r in pii_surrogates.surrogate_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert len(found) == len(texts) and found[1].text == texts[1] and found[9].text == texts[9]
    assert found[8].n_entities == 5000 and len(set(found[8].text.split())) == 1 and "bob" not in found[8].text


def test_check_digits(spark):
    texts = ["4111 1111 1111 1111", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]
    found = {r.doc_id: r for r in pii_surrogates.surrogate_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    rest = lambda x: int("".join(str(int(c, 36)) for c in (x[4:] + x[:4]).replace(" ", ""))) % 97
    assert found[0].text != texts[0] and (found[1].text, found[1].n_entities) == (texts[1], 0)
    assert found[2].text != texts[2] and rest(found[2].text) == 1 and found[2].text[:2] == "DE" and found[2].text[4] == " "
    assert found[3].text != texts[3] and found[3].n_entities == 1


def test_replacement_against_brute_force(spark):
    """Each occurrence, whatever its format, has what the table of surrogates says, and nothing else changes."""
    rnd = random.Random(4)
    kinds = {"ssn": lambda: f"{rnd.randint(100, 999)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", "email": lambda: f"u{rnd.randint(1, 40)}@h{rnd.randint(1, 9)}.net"}
    pool = [(k, make()) for k, make in kinds.items() for _ in range(60)]
    rows = [(i, " ".join(x for _ in range(rnd.randint(0, 5)) for x in ("word", rnd.choice(pool)[1], "3.14,"))) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = {x for _, t in rows for x in t.split()}
    some = sorted({(k, x) for k, x in pool if x in seen})
    entities = spark.createDataFrame(some, "kind string, surface string").withColumn("canonical", pii_surrogates.canonical(F.col("kind"), F.col("surface")))
    made = {r.canonical: r.surrogate for r in pii_surrogates.surrogates(entities).collect()}
    shaped = lambda x, s: "".join(next(it) if c.isalnum() else c for it in [iter(s)] for c in x)
    of = {r.surface: shaped(r.surface, made[r.canonical]) for r in entities.collect()}
    assert len(set(of.values())) == len(of) == len(some) and not set(of.values()) & set(of)
    want = {i: " ".join(of.get(w, w) for w in t.split(" ")) for i, t in rows}
    assert {r.doc_id: r.text for r in pii_surrogates.surrogate_documents(df).collect()} == want


def test_lines_compared_spanning(spark, monkeypatch):
    """Left-out pairs change no group, strays among one another and copies of the largest component included."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rnd = random.Random(10)
    base = ["".join(rnd.choice("abcdef") for _ in range(30)) for _ in range(3)]
    texts = [base[k % 3] + f"{k:03d}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    identities = df.select(F.col("doc_id").alias("id"), *[h.alias(f"h{k + 1}") for k, h in enumerate(line_dedup.identity("text"))])
    classes = line_dedup.classes_of(df).drop("id").join(identities, ["h1", "h2"])
    for known in (0, 9, 29):
        component = F.when((F.col("id") < known) & (F.col("id") % 3 == 0), 0).otherwise(F.col("id"))
        rows = classes.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(7).cast("long"))).alias("key"), "id", "size", "sim", component.alias("component"))
        of = {r.id: r.component for r in rows.collect()}
        every, some = ({(r.a, r.b) for r in line_dedup.compared(rows, classes, df, "text", 0.8, spanning).collect()} for spanning in (False, True))
        assert every == {(a, b) for a in range(30) for b in range(a) if a % 3 == b % 3 and of[a] != of[b]}
        groups = lambda pairs: simhash_trie.forest(30, [tuple(np.array(sorted(pairs | set(of.items()))).T)]).tolist()
        assert some <= every and groups(some) == groups(every)


def test_counts_of_neighbours_bound_edits():
    rnd = random.Random(6)
    for _ in range(300):
        a = "".join(rnd.choice("abé語 ") for _ in range(rnd.randint(1, 60)))
        b, edits = list(a), rnd.randint(0, 12)
        for _ in range(edits):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = [rnd.choice("abé語 ")] * rnd.randint(0, 1)
        x, y = line_dedup.bigrams([a, "".join(b)])
        assert np.abs(x - y).sum() <= 4 * edits


def test_lines_that_share_one_frequent_key_are_compared(spark, monkeypatch):
    """Whatever a bucket's size, lines that meet in it are decided by edit similarity alone: here many
    lines begin with one phrase, and each line's only near copy shares nothing else with it."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for k in range(30):
        tail = [word() for _ in range(6)]
        other = [w[:4] + "z" + w[5:] for w in tail]
        rows += [(2 * k, " ".join(["considerable", "circumstances", *tail])), (2 * k + 1, " ".join(["considerable", "circumstances", *other]))]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    found = {r.id: r["keys"] for r in line_dedup.classes_of(df).select("id", "keys").collect()}
    times = Counter(k for keys in found.values() for k in keys)
    met = {i for i, keys in found.items() if max(times[k] for k in keys) > line_dedup.FEW}
    assert len(met) >= 40
    classes = line_dedup.classes_of(df).localCheckpoint()
    held = {r.h1: (r.id, set(r["keys"])) for r in classes.collect()}
    h1 = {r.doc_id: r.h for r in df.select("doc_id", line_dedup.identity("text")[0].alias("h")).collect()}
    of = {k: held[h] for k, h in h1.items()}
    text = dict(rows)
    want = {(of[a][0], of[b][0]) for a in text for b in text if a < b and of[a][1] & of[b][1] and line_dedup.within(text[a], text[b], int(0.2 * max(len(text[a]), len(text[b])) + 1e-9))}
    assert len(want) >= 15
    component = {r.id: r.component for r in line_dedup.groups(classes, df).collect()}
    assert all(component.get(a) is not None and component.get(a) == component.get(b) for a, b in want)
    assert {i for pair in want for i in pair} == set(component)


def test_unlike_lines_of_a_bucket_are_aligned_at_once(monkeypatch):
    """Of many lines of one bucket only those that are alike cost an edit distance of their own."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9)))
    norms = [" ".join(["considerable", "circumstances", *[word() for _ in range(30)]]) for _ in range(120)]
    norms += [t[:50] + "zz" + t[52:] for t in norms[:7]]
    sizes = [len(t) for t in norms]
    ids = np.arange(len(norms))
    cell = pd.DataFrame({"key": -5, "component": ids, "size": sizes, "stray": ids > 0, "role": 3, "id": ids, "norm": norms, "keys": [[-5]] * len(norms)})
    calls, within = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda *pair: calls.append(pair) or within(*pair))
    assert sorted(p for found in line_dedup.alike_of([cell], 0.8, False) for p in found) == [(120 + k, k) for k in range(7)]
    assert len(calls) < 50


@pytest.mark.parametrize(("letters", "length"), [("ab", 40), ("abcdefgh", 300), ("".join(map(chr, range(0x4E00, 0x4F00))), 150), ("abcdefgh", 900)])
def test_alignment_of_many_pairs_at_once(letters, length):
    """No pair that edit distance links is lost, and with few kinds of letters none is too many."""
    rnd = random.Random(length)
    base, norms = [rnd.choice(letters) for _ in range(length)], []
    for share in np.linspace(0, 0.3, 25):
        line = list(base)
        for _ in range(int(share * length)):
            at, how = rnd.randrange(len(line)), rnd.randrange(3)
            line[at : at + (how > 0)] = [rnd.choice(letters)] * (how < 2)
        norms.append("".join(line))

    def distance(a: str, b: str) -> int:
        row = np.arange(len(b) + 1)
        codes = np.frombuffer(b.encode("utf-32-le"), "<u4")
        for i, x in enumerate(a, 1):
            least = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x))))
            row = np.minimum.accumulate(least - np.arange(len(least))) + np.arange(len(least))
        return int(row[-1])

    sizes = np.array([len(t) for t in norms])
    a, b = np.triu_indices(len(norms), 1)
    edits = (0.2 * np.maximum(sizes[a], sizes[b]) + 1e-9).astype(np.int64)
    near = np.abs(sizes[a] - sizes[b]) <= edits
    a, b, edits = a[near], b[near], edits[near]
    held = line_dedup.possible(line_dedup.kinds_of(norms), np.cumsum(sizes) - sizes, sizes, a, b, edits)
    truth = np.array([distance(norms[x], norms[y]) <= d for x, y, d in zip(a, b, edits)])
    assert 0 < truth.sum() < len(truth)
    assert [line_dedup.within(norms[x], norms[y], d) for x, y, d in zip(a, b, edits.tolist())] == truth.tolist()
    assert (held >= truth).all() and (len(letters) > line_dedup.KINDS or (held == truth).all())


def test_languages_are_told_a_stretch_of_texts_at_a_time(monkeypatch):
    rnd = random.Random(4)
    net = bigru_langid.BiGru.new(["aa", "bb"])
    texts = [bytes(rnd.choices(b"abcdefgh ", k=rnd.choice([1, 63, 64, 65, 700]))) for _ in range(300)] + [b"a" * 20000, b"b"]
    whole = net.documents(texts)
    held, windowed = [], bigru_langid.windowed
    monkeypatch.setattr(bigru_langid, "STRETCH", 100, raising=False)
    monkeypatch.setattr(bigru_langid, "windowed", lambda some: held.append(sum(-(-len(x) // 64) for x in some)) or windowed(some))
    assert np.allclose(net.documents(texts), whole, atol=1e-6) and np.allclose(np.concatenate([net.documents([x]) for x in texts]), whole, atol=1e-6)
    assert max(held) <= 100 + 20000 // 64 + 1 and sorted(held)[-3] <= 112


def test_lines_that_share_just_one_of_many_keys(spark):
    """However many keys a line has, each is one to meet by: here lines of 120 words are alike, but
    by their letters, since all words but two neighbours differ by one."""
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for k in range(20):
        line, at = [word() for _ in range(120)], rnd.randrange(119)
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(w if i in (at, at + 1) else w[:4] + "z" + w[5:] for i, w in enumerate(line)))]
    found = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect() if r.n_removed}
    assert found == {2 * k + 1 for k in range(20)}


def test_pairs_of_several_keys_are_compared_under_the_least():
    keys = [np.array(k, np.int64) for k in ([-9, -5, 3], [-5, 3], [-9, 3], [3], [3, 7])]
    found = line_dedup.met_before(keys, 3)
    assert {(a, b) for a, b in zip(*np.nonzero(found)) if a < b} == {(0, 1), (0, 2)}
    assert not line_dedup.met_before([k[:0] for k in keys], 3).any()


def test_buckets_are_compared_in_rounds(spark, monkeypatch):
    """Texts of only some buckets are shuffled at a time, and no pair gets lost between the rounds."""
    rnd = random.Random(12)
    base = ["".join(rnd.choice("abcdef") for _ in range(30)) for _ in range(3)]
    texts = [base[k % 3] + f"{k:03d}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    identities = df.select(F.col("doc_id").alias("id"), *[h.alias(f"h{k + 1}") for k, h in enumerate(line_dedup.identity("text"))])
    classes = line_dedup.classes_of(df).drop("id").join(identities, ["h1", "h2"])
    own = F.array(*[F.when(F.col("id") % 5 != k, F.lit(k + 3).cast("long")) for k in range(5)])
    rows = classes.select(F.explode(F.filter(own, lambda x: x.isNotNull())).alias("key"), "id", "size", "sim", F.col("id").alias("component"))
    found, cut_small = [], line_dedup.cut_small
    monkeypatch.setattr(line_dedup, "cut_small", lambda df: found.append(cut_small(df)) or found[-1])
    monkeypatch.setattr(line_dedup, "ROUND_ROWS", 1, raising=False)
    every = [(r.a, r.b) for r in line_dedup.compared(rows, classes, df, "text", 0.8).collect()]
    assert sorted(every) == sorted((a, b) for a in range(30) for b in range(a) if a % 3 == b % 3)
    assert sum(x.columns == ["a", "b"] and 0 < x.count() < len(every) for x in found) > 1


def test_alignment_that_needs_no_second_look():
    rnd = random.Random(13)
    rare = [chr(0x4E00 + k) for k in range(80)]
    norms = ["".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(6)] + ["".join(rnd.choice(rare) for _ in range(60)) for _ in range(6)]
    norms += [t[:20] + "z" + t[21:] for t in norms]
    sizes = np.array([len(t) for t in norms])
    begins, kinds = np.cumsum(sizes) - sizes, line_dedup.kinds_of(norms)
    a, b = np.triu_indices(len(norms), 1)
    edits = (0.2 * np.maximum(sizes[a], sizes[b]) + 1e-9).astype(np.int64)
    held, sure = line_dedup.possible(kinds, begins, sizes, a, b, edits), line_dedup.certain(kinds, begins, a, b, edits)
    truth = np.array([line_dedup.within(norms[x], norms[y], d) for x, y, d in zip(a, b, edits.tolist())])
    assert (held == truth)[sure].all() and (held >= truth).all() and truth[sure].any() and not sure.all()
    assert not line_dedup.certain(kinds, begins, a[:3], b[:3], edits[:3]).any()
