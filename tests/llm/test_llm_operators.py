"""Each operator against brute force on small tables that hold nulls, empty, long and repeated
texts, repeated rows, and columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import bigru_langid, bin_completion, bpe_chunks, exact_dedup, line_dedup, pii_surrogates, quality_eb, simhash_trie, url_reputation, vafile_topk
from latticework.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, norm string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", "z", "w") for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéz") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = make(80)
    near = base.split()
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, make(3000)), (8, "one"), (9, base.upper()), (10, base.replace(" ", "  ")), (None, base), (11, "a\x1cb <|endoftext|> 日本語 ΣΑΣ"), (3, " ".join(near))]
    return [(i, t, "en") for i, t in rows] + [(100 + k, make(rnd.randint(1, 60)), "en") for k in range(40)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda t: F.substring(F.md5(t), 1, 1)], ids=["md5", "clashing"])
def test_exact_dedup(spark, texts, hash_of):
    found = exact_dedup.exact_dedup(docs(spark, texts), hash_of=hash_of).collect()
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, _ in texts]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = Counter((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, texts).where("false")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_dedup(spark, texts):
    found = rows_of(simhash_trie.near_dedup(docs(spark, texts)))
    fps = [brute_fingerprint(t) for _, t, _ in texts]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for g, (i, _, _) in zip(group, texts):
        least[g] += [i] if i is not None else []
    want = sorted(((i, f"{f:016x}", min(least[g])) for g, f, (i, _, _) in zip(group, fps, texts)), key=str)
    assert found == want
    kept = [r.doc_id for r in simhash_trie.keep_one(docs(spark, texts)).collect()]
    assert sorted(kept) == sorted({min(x) for x in least.values()})
    assert simhash_trie.near_dedup(docs(spark, texts).where("false")).count() == 0


def test_close_pairs_and_top_of_the_trie():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5)]]))
    near = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    assert {(int(i), int(j)) for a, b in simhash_trie.close_pairs(x, None) for i, j in zip(a, b)} == near
    y, z = x[: len(x) // 2], x[len(x) // 2 :]
    assert {(int(i), int(j) + len(y)) for a, b in simhash_trie.close_pairs(y, z) for i, j in zip(a, b)} == {p for p in near if p[0] < len(y) <= p[1]}
    bits = 8
    sizes = Counter(int(v >> np.uint64(56)) for v in x)
    for subtree in (1, 20, 1000):
        by_pair = defaultdict(lambda: (set(), set()))
        for prefix, pair, right in simhash_trie.top_pairs(dict(sizes), bits, subtree, least=2):
            by_pair[pair][right].add(prefix)
        for i, j in near:
            a, b = int(x[i] >> np.uint64(56)), int(x[j] >> np.uint64(56))
            assert any(a in left and b in (right or left) or b in left and a in (right or left) for left, right in by_pair.values())


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7), (None, 5)]
    random.Random(1).shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 8)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(1000, None, 0), (1001, [None] * 8, 0), (1002, [float("nan")] * 8, 0), (0, [float(x) for x in v[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = rows_of(vafile_topk.exact_top_k(df))
    ids = [*range(400), 0]  # the repeated row is a query, and a candidate, of its own
    n = np.floor(1024 * np.concatenate((v, v[:1])).astype(np.float64)).astype(np.int64)
    want = []
    for q, i in enumerate(ids):
        if i % 100 == 0:
            s = n @ n[q]
            order = sorted((c for c in range(401) if c != q), key=lambda c: (-s[c], ids[c]))[:10]
            want += [(i, r + 1, ids[c], int(s[c])) for r, c in enumerate(order)]
    assert found == sorted(want, key=str)
    assert vafile_topk.exact_top_k(df.where("vec_id = 100")).count() == 0
    assert vafile_topk.exact_top_k(df.where("false")).count() == 0
    assert vafile_topk.exact_top_k(df.where("vec_id < 4")).count() == 8  # two queries, four other rows each


@pytest.fixture(scope="module")
def word_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    return t


def test_packing(spark, texts, word_tokenizer):
    some = [*texts, (500, "abc " * 9000, "en")]
    found = bin_completion.pack(docs(spark, some), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = Counter()
    for i, t, _ in some:
        ids = [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) == -(-sum(r.length for r in found) // 4096)
    assert bin_completion.pack(docs(spark, texts).where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bin_completion_against_exhaustive_search():
    rnd = random.Random(4)

    def fewest(items, room):
        best = len(items)

        def down(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= room:
                    bins[i] += items[k]
                    down(k + 1, bins)
                    bins[i] -= items[k]
            down(k + 1, [*bins, items[k]])

        down(0, [])
        return best

    over = 0
    for _ in range(60):
        items = sorted((rnd.randint(5, 60) for _ in range(9)), reverse=True)
        patterns = bin_completion.solve(dict(Counter(items)), 100)
        held = Counter()
        for p, times in patterns:
            assert sum(p) <= 100
            held.update({s: n * times for s, n in Counter(p).items()})
        assert held == Counter(items)
        over += sum(t for _, t in patterns) - fewest(items, 100)
    assert over <= 2


def test_bpe(spark, texts):
    path = public_tokenizers.path
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.no_truncation()
    rnd = random.Random(1)
    odd = [(1000 + k, "".join(rnd.choice("ab cAé.,'\n  tsre<|>1² ́Σ日\x1c 🙂") for _ in range(rnd.choice([3, 60, 3000]))), "en") for k in range(60)]
    some = [*texts, *odd, (2000, "a" * 5000 + " " * 3000 + "é" * 3000, "en"), (2001, "x<|endoftext|> y", "en")]
    for args in ((path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), ()):
        found = bpe_chunks.encode_documents(docs(spark, some), path("byte_bpe_50k.json"), *args, with_ids=True).collect()
        want = {x: t.encode(x or "", add_special_tokens=False).ids for _, x, _ in some}
        assert len(found) == len(some)
        by_id = {i: x for i, x, _ in some}
        for r in found:
            ids = want[by_id[r.doc_id]] if r.doc_id is not None else want[texts[0][1]]
            decoded = t.decode(ids, skip_special_tokens=False)
            assert r.ids == ids and r.decoded == decoded and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_language_id(spark):
    rnd = random.Random(2)
    sounds = {"aa": "ka ko ta to na no".split(), "bb": "sch ung ver ein ich der".split()}
    rows = [(i, " ".join("".join(rnd.choice(sounds[x]) for _ in range(3)) for _ in range(rnd.randint(5, 60))), x) for i, x in enumerate(["aa", "bb"] * 120)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "aa"), (None, rows[0][1], None), (903, rows[1][1] * 50, None)]
    df = docs(spark, rows + odd)
    found = {r.doc_id: r for r in bigru_langid.identify(df).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out for i in held) and not found[None].held_out
    assert np.mean([found[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert [(found[i].lang_pred, found[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert found[903].lang_pred == "bb" and 0 <= found[903].score <= 1
    assert bigru_langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in bigru_langid.identify(docs(spark, odd[:1] + odd[3:])).collect()} == {"und"}
    assert {r.doc_id for r in bigru_langid.accepted(df).collect()} == set(range(240)) | {None, 903}


def test_gradients():
    net = bigru_langid.BiGru.new(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    w, s, y, k = rng.integers(0, 9, (4, 6)).astype(np.uint8), np.array([6, 6, 3, 1]), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 1.0, 0.5])
    _, g = net.gradients(w, s, y, k)
    for name in g:
        p = net.p[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape) if name[0] != "x" else (rng.integers(0, p.shape[0]), rng.choice(w.ravel()))
            old = p[at]
            losses = []
            for step in (0.01, -0.01):
                p[at] = old + step
                losses.append(net.gradients(w, s, y, k)[0])
            p[at] = old
            assert abs((losses[0] - losses[1]) / 0.02 - g[name][at]) < 2e-3


def test_url_filters(spark):
    urls = ["http://A.Example.com/en/7?x", "http://b.com/en/1", "https://x.net/de/80", "http://sub.example.net/de/8/", "http://org/es/", "http://xorg/es/", None, "nothing", "ftp://h#f", "a://b://c/d"]
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(100 + i, "http://bad.tld/x", "") for i in range(40)] + [(200 + i, f"http://good{i % 5}.tld/x", "") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(40)] + [(200 + i, 1, 0) for i in range(100)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(pages, labels).collect()}
    assert found[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[1] == ("b.com", "/en/1", "com/en/", "block")
    assert found[2] == ("x.net", "/de/80", "net/de/", "allow")
    assert found[3] == ("sub.example.net", "/de/8/", "example.net/de/8", "block")
    assert found[4] == ("org", "/es/", "org/es/", "block")
    assert found[5] == ("xorg", "/es/", None, "allow")
    assert found[6] == found[7] == ("", "", None, "allow")
    assert found[8] == ("h", "", None, "allow") and found[9] == ("b:", "//c/d", None, "allow")
    assert found[100] == ("bad.tld", "/x", None, "block") and found[200][3] == "allow"
    assert {r.verdict for r in url_reputation.filter_urls(pages.where("page_id > 99"), labels.where("false")).collect()} == {"allow"}
    assert url_reputation.filter_urls(pages.where("false"), labels).count() == 0


def edits(a, b):
    y, at = np.array(list(b)), np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a):
        new = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != x))))
        row = np.minimum.accumulate(new - at) + at
    return row[-1]


def brute_norm(line):
    return " ".join(x for x in re.split(r"[\W_]+", line.lower()) if x)


def brute_lines(rows, alike=lambda a, b: 1 - edits(a, b) / max(len(a), len(b)) >= 0.8):
    """{doc_id: positions to drop} by all pairs of normalised lines, edit similarity alone."""
    at = [(i is None, i or 0, k, brute_norm(x)) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n"))]
    at = sorted(x for x in at if x[3])
    norms = sorted({x[3] for x in at})
    group = {x: x for x in norms}
    for k, a in enumerate(norms):
        for b in norms[:k]:
            if group[a] != group[b] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1 and alike(a, b):
                old = group[a]
                group = {x: group[b] if g == old else g for x, g in group.items()}
    seen, gone = set(), defaultdict(list)
    for null, i, k, x in at:
        if group[x] in seen:
            gone[None if null else i].append(k)
        seen.add(group[x])
    return dict(gone)


def test_line_simhash(spark):
    rows = [(" ".join(f"{'longer' * (j % 2)}word{(i * 7 + j * j) % 50}" for j in range(n)),) for i, n in enumerate([5, 6, 9, 40, 63, 64, 127, 128, 300, 20000, 3])] + [("a b c d e",)]
    df = spark.createDataFrame(rows, "text string")
    found = {tuple(r.h): r for r in line_dedup.classes_of(df).select(F.array("h1", "h2").alias("h"), "sim", "keys").collect()}
    assert len(found) == len(rows)
    for r in df.select("text", F.array(*line_dedup.identity("text")).alias("h")).collect():
        words = r.text.split()
        long = [w for w in words if len(w) >= 7]
        some = [w for w in words if len(w) >= 4]
        of = long if len(long) >= 6 else some if len(some) >= 3 else words
        hashes = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in of], ">u8")
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
        mine = found[tuple(r.h)]
        assert mine.sim == int.from_bytes(np.packbits(2 * ones > len(of)).tobytes(), "big", signed=True)
        distinct = len(set(zip(of, of[1:]))) or 1
        assert all(k < 0 for k in mine.keys) and len(mine.keys) >= min(6, distinct)


def test_simhash_of_long_and_short_lines():
    sizes = np.array([1, 254, 255, 256, 4, 1000])
    hashes = np.random.default_rng(1).integers(0, 1 << 64, sizes.sum(), np.uint64)
    for sim, own in zip(line_dedup.simhashes(hashes, sizes), np.split(hashes, np.cumsum(sizes)[:-1])):
        assert sim == sum(1 << k for k in range(64) if 2 * int(((own >> np.uint64(k)) & np.uint64(1)).sum()) > len(own))


def test_edits_against_the_table_of_distances():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], min(row[k + 1] + 1, row[k] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(5)
    for _ in range(600):
        a = "".join(rnd.choice("abé語") for _ in range(rnd.randint(0, 90)))
        b = list(a)
        for _ in range(rnd.randint(0, 20)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 2)] = [rnd.choice("abé語") for _ in range(rnd.randint(0, 2))]
        b = "".join(b)
        d = table(a, b)
        assert line_dedup.within(a, b, d) and line_dedup.within(b, a, d + 1) and not (d and line_dedup.within(a, b, d - 1))


def test_line_dedup(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9))) for _ in range(500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    a, b, c = line(60), line(8), line(2500)
    near = a.split()
    near[30] += "x"
    rows = [(1, f"{a}\n{line(30)}\nshort line", "en"), (2, f"{b}\n{a.upper()}!\nshort line", "en"), (3, " ".join(near) + "\n\n" + line(9), "en"), (4, None, "en"), (5, "", "en"), (6, c, "en"), (7, c + " end", "en"), (None, b, "en"), (8, b + "\n" + b, "en"), (9, line(40), "en")]
    df = docs(spark, rows)
    found = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.dedup_lines(df).collect()}
    assert found[1] == (3, 0, []) and found[2] == (3, 2, [1, 2]) and found[4] == found[5] == (1, 0, []) and found[3] == (3, 1, [0])
    assert found[7] == (1, 1, [0]) and found[6][1] == 0 and found[None] == (1, 1, [0]) and found[8] == (2, 2, [0, 1]) and found[9][1] == 0
    cleaned = line_dedup.clean(df)
    assert cleaned.columns == df.columns
    text = {r.doc_id: r.text for r in cleaned.collect()}
    assert text[2] == b and text[4] is None and text[5] == "" and text[8] == "" and text[1] == rows[0][1]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    names = ["_r1", "_r2", "_removed", "line", "pos", "h1", "component", "kept"]
    df = spark.createDataFrame([(1, "one line\nanother", *names), (2, "one line", *names), (2, "one line", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.clean(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "one line\nanother", *names), (2, "", *names), (2, "", *names)]


def test_lines_linked_against_brute_force(spark):
    """Groups of near copies larger than FEW, so that pairs of keys and one compared line count."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    base = [[rnd.choice(words) for _ in range(30)] for _ in range(4)]
    rows = []
    for k in range(60):
        w = list(base[k % 4])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(30)] = rnd.choice(words)
        rows.append((k, " ".join(w), "en"))
    for k in range(20):  # one phrase in many lines that are not alike
        rows.append((100 + k, f"{' '.join(rnd.choice(words) for _ in range(12))} considerable circumstances notwithstanding {' '.join(rnd.choice(words) for _ in range(12))}", "en"))
    found = {r.doc_id: r.removed for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r.n_removed}
    assert found == brute_lines(rows)


def test_lines_compared_by_parts(spark, monkeypatch):
    """Parts of a bucket, pairs that share two keys, and lines of one component."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdef") for _ in range(30)) for _ in range(3)]
    texts = [base[k % 3] + f"{k:03d}" for k in range(30)]
    df = docs(spark, [(k, t, "en") for k, t in enumerate(texts)])
    classes = line_dedup.classes_of(df).join(df.select("doc_id", *[h.alias(f"h{k + 1}") for k, h in enumerate(line_dedup.identity("text"))]), ["h1", "h2"]).drop("id").withColumnRenamed("doc_id", "id")
    rows = classes.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(7).cast("long"))).alias("key"), "id", "size", "sim", F.when(F.col("id") < 6, 0).otherwise(F.col("id")).alias("component"))
    found = sorted((r.a, r.b) for r in line_dedup.compared(rows, classes, df, "text", 0.8).collect())
    assert found == sorted((a, b) for a in range(30) for b in range(a) if a % 3 == b % 3 and a >= 6)


def test_short_and_odd_lines_against_brute_force(spark):
    rnd = random.Random(8)
    pool = ["Read more", "read  more!", "All rights reserved", "ALL RIGHTS RESERVED.", "今日は天気がいいですね散歩に行きましょう", "今日は天気がいいですよ散歩に行きましょう", "---", "", " ", "x", "X", "1", "привет всем друзьям сегодня", "привет всем друзьям сегодни", "a_b", "a b", "ÀÉÎ õü", "àéî õü"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6))), "en") for k in range(30)] + [(None, "Read more\n x", "en"), (40, None, "en")]
    found = {r.doc_id: r.removed for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r.n_removed}
    assert found == brute_lines(rows)


def test_pii(spark):
    rows = [
        (1, "Mail Ann.Lee@Mail3.Example.com or ann.lee@mail3.example.com, call +1 (017) 555-7713 or +1 017 555 7713."),
        (2, "Mrs. Anna Schmidt met Mr. John Smith; Mrs. Schmidt and Господин Иванов, Mr. SMITH."),
        (3, "at 97.51.17.173 card 4111 1111 1111 1111 or 4111111111111111"),
        (4, None), (5, ""), (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (7, "plain text, 12345 and 3.14."), (7, "plain text, 12345 and 3.14."), (None, "at 97.51.17.173"), (3, "at 97.51.17.173 card 4111 1111 1111 1111 or 4111111111111111"),
    ]
    df = docs(spark, [(i, t, "en") for i, t in rows])
    found = pii_surrogates.surrogate_documents(df).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r.text for r in found}
    assert text[4] is None and text[5] == "" and text[7] == rows[6][1]
    a, b = re.findall(r"\S+@\S+\.com", text[1])
    assert a.lower() == b and a != "Ann.Lee@Mail3.Example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", a)
    p, q = re.findall(r"\+1[ ()\d-]+", text[1])
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713"
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+); Mrs\. (\w+) and Господин ([а-яА-Я]+), Mr\. (\w+)\.", text[2])
    assert m and m[1].endswith("a") and m[3].endswith("n") and m[2] == m[5] and m[7] == m[4].upper() and m[2] != m[4]
    c = re.findall(r"\d{4} \d{4} \d{4} \d{4}", text[3])[0].replace(" ", "")
    assert c in text[3] and c != "4111111111111111" and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(c))) % 10 == 0
    assert text[None] == text[3].split(" card")[0] != "at 97.51.17.173"
    assert pii_surrogates.surrogate_documents(df, key="other").where("doc_id = 6").first().text != text[6]
    assert pii_surrogates.surrogate_documents(df.where("false")).count() == 0


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)], "kind string, canonical string")
    made = pii_surrogates.surrogates(entities, make=lambda attempt, key: F.substring(F.translate("at", "abcdef", "012345"), 1, 4 + attempt // 8)).collect()
    assert len(made) == 300 and len({r.surrogate for r in made}) == 300 and len({r.canonical for r in made}) == 300


def test_quality(spark):
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(60)) + "."
    bad = lambda: " ".join(["spam$$$"] * 60)
    rows = [(i, good() if i % 3 else bad(), "en") for i in range(150)] + [(900, None, None), (901, "", "en"), (None, good(), "xx")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    found = {r.doc_id: r for r in quality_eb.classify(df, labels).collect()}
    assert len(found) == len(rows) and all(found[i].kept == (i % 3 > 0) for i in range(150))
    assert not found[900].kept and found[901].quality == 0 and found[None].kept
    assert quality_eb.classify(df, labels.where("false")).where("doc_id = 1").first().text_score == 0.5
    assert quality_eb.classify(df.where("false"), labels).count() == 0


def test_site_posteriors_shrink(spark):
    rows = [("a", "x", 1)] * 400 + [("b", "x", 0)] + [("c", "x", 0)] * 400
    rate, hosts, paths = quality_eb.site_posteriors(spark.createDataFrame(rows, "host string, path string, good long"), 20.0, 20.0)
    h = {r.host: r.host_rate for r in hosts.collect()}
    assert h["a"] > 0.95 and h["c"] < 0.05 and abs(h["b"] - rate) < 0.05


def test_site_posteriors_against_closed_form(spark):
    """Strengths fitted by moments at each level, and beta-binomial means with them."""
    rnd = random.Random(3)
    rows = [(f"h{h}", f"p{p}", int(rnd.random() < q)) for h in range(12) for q in [rnd.betavariate(6, 3)] for p in range(3) for _ in range(rnd.randint(1, 40))]
    rate, hosts, paths = quality_eb.site_posteriors(spark.createDataFrame(rows, "host string, path string, good long"))

    def counted(key):
        out = defaultdict(lambda: [0, 0])
        for r in rows:
            out[key(r)][0] += 1
            out[key(r)][1] += r[2]
        return dict(out)

    def weight(groups):
        n, bad = np.array([x[0] for x in groups.values()], float), np.array([x[0] - x[1] for x in groups.values()], float)
        p, k = bad.sum() / n.sum(), len(n)
        between = (n * (bad / n - p) ** 2).sum()
        rho = (between / (p * (1 - p)) - (k - 1)) / (n.sum() - (n * n).sum() / n.sum() - (k - 1))
        return (1 - min(0.999, max(0.001, rho))) / min(0.999, max(0.001, rho))

    by_host, by_path = counted(lambda r: r[0]), counted(lambda r: r[:2])
    assert abs(rate - (sum(r[2] for r in rows) + 1) / (len(rows) + 2)) < 1e-12
    a, b = weight(by_host), weight(by_path)
    want = {h: (g + a * rate) / (n + a) for h, (n, g) in by_host.items()}
    assert all(abs(r.host_rate - want[r.host]) < 1e-9 for r in hosts.collect())
    assert all(abs(r.path_rate - (by_path[r.host, r.path][1] + b * want[r.host]) / (by_path[r.host, r.path][0] + b)) < 1e-9 for r in paths.collect())


def test_registered_domains(spark):
    hosts = ["a.example.com", "example.com:8080", "u:p@example.com", "10.0.0.1", "[::1]:80", "a.b.co.uk", "", "com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    of = lambda *s: [r[0] for r in df.select(url_reputation.registered_domain(F.col("host"), *s)).collect()]
    assert of() == ["example.com"] * 3 + ["10.0.0.1", "[::1]", "co.uk", "", "com"]
    assert of(("co.uk",))[5] == "b.co.uk"


def test_top_k_of_repeated_ids_and_a_common_vector(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-50, 50, (300, 4)) / 16.0
    v[20:220] = v[100]
    ids = [*range(290), 0, 0, 100, 5, 5, 7, 300, 300, 300, 9]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<float>").repartition(5)
    n = np.floor(1024 * v).astype(np.int64)
    want = []
    for q, i in enumerate(ids):
        if i % 100 == 0:
            order = sorted((-int(n[q] @ n[c]), ids[c]) for c in range(300) if c != q)[:10]
            want += [(i, r + 1, c, -s) for r, (s, c) in enumerate(order)]
    assert rows_of(vafile_topk.exact_top_k(df)) == sorted(want, key=str)


def test_language_of_long_texts_against_a_plain_loop():
    """Each byte of each window, one at a time, both ways from a zero state."""
    net = bigru_langid.BiGru.new(["a", "b", "c"], hidden=4)
    sig = lambda x: 1 / (1 + np.exp(-x))
    texts = [bytes(np.random.default_rng(k).integers(1, 256, n, dtype=np.uint8)) for k, n in enumerate((1, 63, 64, 65, 200, 3000))]

    def states(d, window):
        x, u, c = net.p[f"x{d}"], net.p[f"u{d}"], net.p[f"c{d}"][:, 0]
        s, out = np.zeros(4), {}
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            i, r = x[:, window[t]], u @ s
            z, g = sig(i[:4] + r[:4]), sig(i[4:8] + r[4:8])
            s = z * s + (1 - z) * np.tanh(i[8:] + g * (r[8:] + c))
            out[t] = s
        return out

    for text, found in zip(texts, net.documents(texts)):
        total = np.zeros(3)
        for at in range(0, len(text), bigru_langid.WINDOW):
            window = text[at : at + bigru_langid.WINDOW]
            f, b = states("f", window), states("b", window)
            for t in range(len(window)):
                y = np.exp(net.p["v"] @ np.concatenate((f[t], b[t])) + net.p["b"][:, 0])
                total += y / y.sum()
        assert np.abs(found - total / len(text)).max() < 1e-4
