"""Unknown-word makers, nodes from templates and entries, and candidates in two stages."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.functions import chars, kana
from latticework.operators import nodes, search, seeds, trie
from latticework.plans import candidates

ID = ["id"]


def sentences(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def words(spark, *of):
    return spark.createDataFrame([(w,) for w in of], "surface string")


@pytest.mark.parametrize(
    "dic, text, have, count",
    [("x ほげ", "ほげーーほげ", "ほげー ほげーー", 4), ("せが", "せーがーー", "せーがー せーが", 3), ("走る 蹴", "走ーる蹴ー", "走ーる 蹴 蹴ー", 3), ("せが", "せがぁぁ", "せがぁ せがぁぁ", 3), ("せが", "せがぁぁっ", "せが せがぁ せがぁぁ せがぁぁっ", 4), ("せが", "せがぁぁーー", "せが せがぁぁー せがぁぁーー", 5)]
    + [("せがあ", "せがー", "せがー", 1), ("せがあ", "せがぁ", "せがぁ", 1), ("せが", "せがぃ", "せが", 1), ("せが", "せがっ", "せが せがっ", 2), ("せが", "せっが", "せっが", 1), ("セガ", "セッガ", "セッガ", 1), ("せガ", "せッガ", "", 0), ("引張る", "引っ張る", "", 0)]
    + [("せが", "せーっが", "せーっが", 1), ("せが", "せがーっ", "せが せがー せがーっ", 3), ("てめえ", "てめー", "てめー", 1), ("ツリー", "ツリーーー", "ツリーーー ツリーー", 3)],
)
def test_altered_spellings(spark, dic, text, have, count):
    s, w = sentences(spark, text), words(spark, *dic.split())
    plain = {(r.start, r.surface) for r in trie.lookup(s, w, ID).collect()}
    alike = trie.lookup(s, w, ID, alike=True).collect()
    assert set(have.split()) <= {x for _, x in plain} | {r.written for r in alike}
    assert len(plain) + len(alike) == count and all(r.written == text[r.start : r.end] for r in alike)


def test_flags_of_spellings(spark):
    found = {r.written: r.flags for r in trie.lookup(sentences(spark, "てめーっ"), words(spark, "てめえ"), ID, alike=True).collect()}
    long = kana.ORIGINAL | kana.REPLACE | kana.REPLACE_PROLONG | kana.E_ROW
    assert found == {"てめー": long, "てめーっ": long | kana.DELETE | kana.DELETE_TSU | kana.DELETE_LAST}


def test_batch_rules_are_those_of_columns(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("あかえけせがーっッぁぃぅぇぉゎヶケカ走x、 〜ｰ") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    rows = kana.with_char_lattice(sentences(spark, *texts), "text").collect()
    begins, codes = trie.codes_of([r.text for r in rows])
    alts, drop = kana.alternatives(codes)
    for r, at in zip(rows, begins):
        for k, x in enumerate(r.lattice):
            assert [(ord(a.alt), a.flag) for a in x.alts] == [(int(c[at + k]), int(f[at + k])) for c, f in alts if c[at + k]] and x["drop"] == drop[at + k], (r.text, k)
    every = [chr(c) for c in range(1, 0x3100)] + list("走〇数ｱＡ🎌")
    found = spark.createDataFrame([(c,) for c in every], "c string").select("c", chars.char_class(F.col("c")).alias("k")).collect()
    assert chars.classes_of(trie.codes_of(["".join(r.c for r in found)])[1][:-1]).tolist() == [r.k for r in found]


@pytest.mark.parametrize("block", [trie.BLOCK, 4])
def test_makers_against_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rnd = random.Random(6)
    dic = {"".join(rnd.choice("ab1") for _ in range(rnd.randint(1, 4))) for _ in range(12)}
    texts = ["".join(rnd.choice("abc12.") for _ in range(rnd.randint(0, 14))) for _ in range(40)] + ["abab", "abababab1", "cbacbaa", ""]
    s, w = sentences(spark, *texts), words(spark, *dic)
    begun = {x[:k] for x in dic for k in range(1, len(x) + 1)}
    alph = lambda x: all(c in "abc" for c in x)
    spans = [(i, a, z) for i, t in enumerate(texts) for a in range(len(t)) for z in range(a + 1, len(t) + 1)]
    got = lambda df: {(r.id, r.start, r.end, r.surface, r.not_prefix) for r in df.collect()}
    told = lambda i, a, z: (i, a, z, texts[i][a:z], int(texts[i][a:z] not in begun))
    assert got(seeds.chunks(s, w, ID, "ALPH")) == {told(*x) for x in spans if alph(texts[x[0]][x[1] : x[2]]) and texts[x[0]][x[1] : x[2]] not in dic}
    assert got(seeds.single(s, w, ID, "ALPH|SYMBOL")) == {told(i, a, z) for i, a, z in spans if z == a + 1 and texts[i][a] in "abc." and texts[i][a] not in dic}
    twice = {(i, a, z) for i, a, z in spans for h in (2, 3, 4) if z - a == 2 * h and texts[i][a : a + h] == texts[i][a + h : z] and alph(texts[i][a:z]) and texts[i][a:z] not in dic and len(texts[i]) - a > 4}
    assert {(r.id, r.start, r.end) for r in seeds.onomatopoeia(s, w, ID, "ALPH").collect()} == twice


def test_nodes_of_templates_and_entries(spark):
    entries = spark.createDataFrame([(1, "x", "x", "symbol", "s"), (2, "せが", "せが", "noun", "a"), (3, "せが", "為", "verb", "b")], "row_no long, surface string, base string, pos string, sub string")
    fields = ["surface", "base", "pos", "sub"]
    templates = nodes.template_rows(entries, {"signs": (1, ["surface", "base"])}, fields)
    seeded = seeds.single(sentences(spark, "せ。"), entries, ID, "IDEOGRAPHIC_PUNC").withColumn("maker", F.lit("signs"))
    assert [(r.start, r.surface, r.base, r.pos, r["sub"], r.not_prefix) for r in nodes.materialised(seeded, templates, fields).collect()] == [(1, "。", "。", "symbol", "s", 1)]
    found = nodes.normalised(sentences(spark, "せがー"), entries, ID, fields).collect()
    flags = kana.ORIGINAL | kana.DELETE | kana.DELETE_PROLONG | kana.DELETE_LAST
    assert {(r.surface, r.base, r.pos, r["sub"], r.flags) for r in found} == {("せがー", "せが", "noun", "a", flags), ("せがー", "為", "verb", "b", flags)}
    left = nodes.unmatched(seeded.select("surface").unionByName(words(spark, "せが")), entries, {"surface": "x", "pos": "noun", "sub": "z"}, ["surface", "sub"])
    assert [r.surface for r in left.collect()] == ["。"]


def test_entries_too_many_to_be_sent(spark, monkeypatch):
    hits = spark.createDataFrame([(i, i % 5, "ab"[i % 2]) for i in range(50)], "id int, start int, surface string")
    entries = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "surface string, n int")
    plain = sorted(map(tuple, nodes.attached(hits, entries, ID).select("id", "start", "surface", "n").collect()))
    monkeypatch.setattr(trie, "BLOCK", 0)
    assert sorted(map(tuple, nodes.attached(hits, entries, ID).select("id", "start", "surface", "n").collect())) == plain and len(plain) == 50


def test_two_stages(spark):
    makers = [candidates.Maker("figures", "chunk", "FIGURE", 5), candidates.Maker("numbers", "numeric", price=3), candidates.Maker("altered", "normalize", price=2), candidates.Maker("any", "single", "ALPH|HIRAGANA", 9, low=True)]
    texts = ["ab12", "abz", "せがーab", "", "ab。", None]
    made = candidates.candidates(sentences(spark, *texts), words(spark, "ab", "せが", "b"), makers, ID)
    rows = {r.id: r for r in made.collect()}
    assert {i: r.connects for i, r in rows.items()} == {0: True, 1: True, 2: True, 3: True, 4: False}
    assert {(e.start, e.end, e.maker) for e in rows[0].edges} == {(0, 2, 0), (1, 2, 0), (2, 3, 1), (3, 4, 1), (2, 4, 1), (2, 4, 2), (3, 4, 2)}
    assert {(e.start, e.end, e.maker, e.flag) for e in rows[1].edges if e.maker == 4} == {(0, 1, 4, 0), (2, 3, 4, 1)}
    assert [(e.start, e.end) for e in rows[2].edges if e.maker == 3] == [(0, 3)]
    found = {(r.id, r.pos, r.surface, r.maker) for r in search.segment_candidates(made, ID).collect()}
    assert {x for x in found if x[0] < 4} == {(0, 0, "ab", 0), (0, 1, "12", 2), (1, 0, "ab", 0), (1, 1, "z", 4), (2, 0, "せがー", 3), (2, 1, "ab", 0)}
    assert candidates.rows_of(made, ID).where("surface = 'せがー'").first().price == 2


def test_numbers_that_are_words(spark):
    entries = spark.createDataFrame([("12", "number"), ("7", "name"), ("ab", "noun")], "surface string, pos string")
    s = sentences(spark, "ab12", "7ab")
    plain, told = candidates.Maker("n", "numeric"), candidates.Maker("n", "numeric", template=(("pos", "number"), ("surface", "0")), overlaid=("surface",))
    made = lambda m: {(r.id, r.start, r.surface, r.flag) for r in candidates.made(m, s, entries, ID).collect()}
    assert made(plain) == {(0, 3, "2", 1)}
    assert made(told) == {(0, 3, "2", 1), (1, 0, "7", 0)}
