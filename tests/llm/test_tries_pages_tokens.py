"""The prefix trie, HTML extraction and token alignment against brute force and made pages."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from latticework.llm import dom_trees, prefix_trie, token_alignment


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1]))] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        ends = sorted(c for c in of if len(convs[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_at_once", [1, 6, 4096])
def test_prefix_trie(spark, monkeypatch, rows_at_once):
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 64), 200, 219, 4321]:
        for k in range(rnd.choice((0, 1, 2, 3, 5, 9))):
            rows.append((c, k, rnd.choice(("user", "assistant", None)), rnd.choice(("", None, "a b", "a  b", "x", "ä\tö ü"))))
    rows += [(20, None, "user", "first of all"), (None, 0, "user", "of none"), (80, 1, "u", "t"), (80, 1, "u", "t"), (81, 0, "u", "t"), (82, 0, None, None), (100, 0, "user", "w " * 50)]
    rows += [(500 + c, k, "user", f"turn {k}") for c in range(30) for k in range(60 - c % 3)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", chain string, h string").repartition(3)
    monkeypatch.setattr(prefix_trie, "ROWS", rows_at_once)
    monkeypatch.setattr(prefix_trie, "HOT", 10)
    if rows_at_once == 1:  # a round a level: keep it short
        rows = [r for r in rows if r[0] is None or r[0] < 500]
        df = df.where("conv_id is null or conv_id < 500")
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


PATHS = [*map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN]


def brute_alignment(rows):
    own, per, held = token_alignment.pair_of(*PATHS), [], Counter()
    for i, text in rows:
        a, b, groups = [], [], []
        if text:
            a, b = own.byte_level.encode(" " + text, add_special_tokens=False).ids, own.pieces.encode(text)
            data = (" " + text).encode()
            if b"".join(own.a_bytes[x] for x in a) != data or b"".join(own.b_bytes[x] for x in b) != data:
                a, b = [], []
        x, y, ends_a, ends_b, j = [], [], 0, 0, 0
        for t in a:
            x.append(t)
            ends_a += len(own.a_bytes[t])
            while ends_b < ends_a:
                y.append(b[j])
                ends_b += len(own.b_bytes[b[j]])
                j += 1
            if ends_a == ends_b:
                groups.append((x, y))
                x, y = [], []
        links = [(p, q) for g, h in groups for p in g for q in h]
        held.update(set(links))
        per.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    said = lambda groups: hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
    return sorted(((i, a, b, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), said(g)) for i, a, b, g, links in per), key=str)


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 40])
def test_token_alignment(spark, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 3000)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeéßz") for _ in range(rnd.randint(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rnd.randint(1, 60)))) for k in range(60)]
    rows += [(1, None), (None, ""), (2, rows[3][1]), (2, rows[3][1]), (None, "a <|endoftext|> </s><s> <unk> b"), (70, "日本語 テキスト 𓀀 Ωß"), (71, "▁ <0x41>"), (72, " " * 3000 + "x" * 500 + "\n\n\t "), (73, "ﬁ Å é \xa0 naïve"), (74, " ".join(word() for _ in range(9000)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair int, key string").repartition(4)
    assert sorted((tuple(r) for r in token_alignment.cross_alignment(df, *PATHS).collect()), key=str) == brute_alignment(rows)
    assert token_alignment.cross_alignment(df.where("false"), *PATHS).count() == 0


def test_both_libraries_of_the_first_vocabulary_agree():
    own = token_alignment.pair_of(*PATHS)
    rnd = random.Random(9)
    signs = [chr(c) for c in range(1, ord(token_alignment.SETTLED))]
    for _ in range(300):
        text = " " + "".join(rnd.choice(signs if rnd.random() < 0.4 else "ab 's\n 1") for _ in range(200))
        assert own.ranks.encode_ordinary(text) == own.byte_level.encode(text, add_special_tokens=False).ids


def test_pairs_of_large_groups_are_counted_by_distinct_ids(monkeypatch):
    own = token_alignment.pair_of(*PATHS)
    tokens = [own.tokens(t) for t in ("some words of a text", "日本語テキスト" * 20, None)]
    plain = token_alignment.align(tokens, own)
    monkeypatch.setattr(token_alignment, "LARGE", 0)
    for x, y in zip(plain, token_alignment.align(tokens, own)):
        assert x[:3] == y[:3] and np.array_equal(x[3], y[3]) and np.array_equal(x[4], y[4])


PROSE = ["The river rose for three days, and on the fourth the bridge was closed to all.", "Nobody in the village, not even the miller, could remember such a spring.", "Yes.", "They carried the flour up the hill, sack after sack, until the barn was full; then they waited.", "It rained."]
JUNK = ["Home", "About us", "All rights reserved", "We use cookies to make this site better for you.", "Great deal on boots, buy two and pay one.", "I don't agree with the writer at all, the mill was never closed!", "Subscribe to our letter", "Most read today"]


def made_page(style):
    paragraphs = "".join(f"<p>{t}</p>" for t in PROSE)
    if style == "article":
        return f"<body><nav><a href=/>{JUNK[0]}</a> <a href=/a>{JUNK[1]}</a></nav><article><h1>A wet spring</h1>{paragraphs}</article><footer>&copy; {JUNK[2]}</footer>"
    if style == "divs":
        return f"<div id=menu><ul><li><a href=/>{JUNK[0]}</a><li><a href=/a>{JUNK[1]}</a></ul></div><div class='cookie-notice'>{JUNK[3]}</div><div class='post-content'><h1>A wet spring</h1>{paragraphs}<div class=ad>{JUNK[4]}</div></div><div id=comments><div class=comment><p>{JUNK[5]}</p></div></div><div class=footer>{JUNK[2]}</div>"
    return f"<header class=site-header><a href=/>{JUNK[0]}</a></header><main><section class=story><h1>A wet spring</h1>{paragraphs}</section><aside class=sidebar><h3>{JUNK[7]}</h3><ul><li><a href=1>{JUNK[1]}</a></li></ul></aside><form class=newsletter>{JUNK[6]}<input></form></main><section class='comments'><ol><li class=comment><p>{JUNK[5]}</p></li></ol></section>"


def test_main_text_of_made_pages(spark):
    rows = [(k, f"http://x.example/{k}", made_page(style)) for k, style in enumerate(("article", "divs", "sections") * 12)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p>cut <b"), (None, "u", made_page("article")), (0, rows[0][1], rows[0][2]), (103, "u", "<article>" + "<p>A line of prose that is repeated, again and again.</p>" * 20000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    found = {}
    got = dom_trees.main_texts(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)
    found = {r.page_id: r for r in got}
    want = "\n".join(["A wet spring", *PROSE])
    assert all(found[k].text == want and found[k].n_chars == len(want) for k in [*range(36), None])
    assert found[100].text == found[101].text == "" and found[101].n_chars == 0
    assert found[103].text.count("\n") == 19999
    assert dom_trees.main_texts(df.where("false")).count() == 0


def test_held_out_layouts():
    trees = dom_trees.learned([made_page(s) for s in ("article", "divs", "sections")])
    assert trees.losses[-1] < 0.1
    rnd, hit, said, true = random.Random(77), 0, 0, 0
    for _ in range(150):
        page = dom_trees.parse(dom_trees.layout(rnd, PROSE + JUNK), trees.bits)
        want = [t is not None and dom_trees.MARK in t for t in page.texts]
        page.texts = [t and t.replace(dom_trees.MARK, "") for t in page.texts]
        x, at = dom_trees.numbers([page])
        kept = dom_trees.decode(trees.scores([page], x), at)
        sizes = [len(t or "") for t in page.texts]
        hit += sum(n for n, w, k in zip(sizes, want, kept) if w and k)
        said += sum(n for n, k in zip(sizes, kept) if k)
        true += sum(n for n, w in zip(sizes, want) if w)
    assert hit / said > 0.93 and hit / true > 0.93


def test_decoding_is_the_likeliest_choice():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        html, open_ = "", 0
        for _ in range(7):
            html += "<div>"
            open_ += 1
            for _ in range(rnd.integers(0, open_ + 1)):
                html += "</div>"
                open_ -= 1
        page = dom_trees.parse(html, {})
        n = len(page.parent)
        odds = rnd.normal(0, 2, n)
        at = dom_trees.numbers([page])[1]
        kept = dom_trees.decode(odds, at)
        value = lambda k: sum(-np.logaddexp(0, -o if x else o) for x, o in zip(k, odds))
        legal = [k for k in itertools.product((False, True), repeat=n) if all(not x or page.parent[i] < 0 or k[page.parent[i]] for i, x in enumerate(k))]
        assert kept.tolist() == list(max(legal, key=value))


def test_pages_are_read_as_browsers_do():
    read = lambda html: [t for t in dom_trees.parse(html, {}).texts if t is not None]
    assert read("<ul><li>a<li>b</ul><p>c<p>d<div>e</div>f") == ["a", "b", "c", "d", "e", "f"]
    assert read("<p>x<b>y</b> &amp; &copy;&nbsp;z<br>w</p>") == ["xy & © z w"]
    assert read("<script>if (a<b) '<p>no'</script>a<!-- <p>no --><style>p{}</style>b") == ["ab"]
    assert read("1 < 2 and <a title='>'>3</a> <p title=\"open>4") == ["1 < 2 and 3", "4"]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert len(read("<div>" * 30000 + "deep")) == 1
