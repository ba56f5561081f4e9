"""The library's own operators: golden cases and brute force."""

import itertools
import random

import numpy as np
import plain_search
import pytest
from pyspark.sql import functions as F

from latticework import catalog
from latticework.functions import chars, hashing, kana
from latticework.operators import dictionary, evaluation, formats, search, seeds, trie
from latticework.sources import text as source

ID = ["id"]


def sentences(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def words(spark, *of):
    return spark.createDataFrame([(w,) for w in of], "surface string")


def spans(df):
    return {(r.start, r.surface) for r in df.collect()}


@pytest.mark.parametrize("ch, names", [(" ", "SPACE"), ("。", "IDEOGRAPHIC_PUNC"), ("あ", "HIRAGANA"), ("ぁ", "HIRAGANA|SMALL_KANA"), ("ッ", "KATAKANA|SMALL_KANA"), ("ー", "HIRAGANA|KATAKANA|CHOON"), ("ｱ", "HANKAKU_KANA"), (".", "SYMBOL"), ("．", "PERIOD"), ("@", "ALPH"), ("Ａ", "ALPH"), ("数", "FIGURE_EXCEPTION|KANJI"), ("十", "KANJI_FIGURE|FIGURE_DIGIT"), ("走", "KANJI"), ("「", "BRACKET"), ("7", "FIGURE")])
def test_char_class(spark, ch, names):
    row = spark.createDataFrame([(ch,)], "c string").select(chars.char_class(F.col("c")).alias("a"), F.expr(chars.class_sql("ascii(c)")).alias("b")).first()
    assert row.a == row.b == chars.class_by_name(names)


def test_rolling_hash():
    state = np.uint64(hashing.SEED0)
    for x in (3, 0, hashing.ORDER_SEEDS[1], 42):
        state = hashing.mix(state, x)
    assert int(state) == 0xE17F94E9ABF9BE0D == int(hashing.ngram_hash(0, 42))


@pytest.mark.parametrize("text, start, number", [("数ミリ", 0, "数ミリ"), ("数十", 0, "数十"), ("数十", 1, "十"), ("４．５６", 0, "４．５６"), ("これは１４ぶんの５", 3, "１４ぶんの５"), ("これは１４ぶんの５", 4, "４ぶんの５"), ("１２．", 0, "１２"), ("1,234", 0, "1,234"), ("1,23", 0, "1"), ("何", 0, None), ("５キロ", 0, "５キロ")])
def test_numbers(spark, text, start, number):
    found = spans(seeds.numbers(sentences(spark, text), ID))
    assert (start, number) in found if number else all(s != start for s, _ in found)


def test_onomatopoeia(spark):
    assert seeds.onomatopoeia(sentences(spark, "ほげほげニャンニャンﾁｸﾀｸﾁｸﾀｸ"), words(spark, "ほげ"), ID, "FAMILY_KANA").count() == 3
    assert seeds.onomatopoeia(sentences(spark, "あいうえおあいうえお"), words(spark, "hoge"), ID, "FAMILY_KANA").count() == 0


def test_chunks_and_singles(spark):
    found = spans(seeds.chunks(sentences(spark, "dxa"), words(spark, "xa"), ID, "ALPH"))
    assert found == {(0, "d"), (0, "dx"), (0, "dxa"), (1, "x"), (2, "a")}
    found = spans(seeds.chunks(sentences(spark, "dx1a"), words(spark, "dx", "1"), ID, "ALPH"))
    assert found == {(0, "d"), (1, "x"), (3, "a")}
    assert {(r.surface, r.not_prefix) for r in seeds.single(sentences(spark, "dx"), words(spark, "d", "xy"), ID, "ALPH").collect()} == {("x", 0)}


@pytest.mark.parametrize("text, normal", [("せーがー", "せが"), ("走ーる", "走る"), ("てめー", "てめ"), ("ねぇ", "ね"), ("うっ", "う"), ("abc", "abc")])
def test_char_lattice(spark, text, normal):
    df = kana.with_char_lattice(spark.createDataFrame([(text,)], "t string"), "t")
    assert df.select(kana.normal_form("lattice")).first()[0] in (normal, normal.replace("ね", "ねえ") if text == "ねぇ" else normal)


def test_char_lattice_alternatives(spark):
    row = kana.with_char_lattice(spark.createDataFrame([("てめー",)], "t string"), "t").first().lattice
    assert [(a.alt, a.flag) for a in row[2].alts] == [("い", kana.REPLACE | kana.REPLACE_PROLONG), ("え", kana.REPLACE | kana.REPLACE_PROLONG | kana.E_ROW)] and row[2].drop == kana.DELETE | kana.DELETE_PROLONG


def test_lookup_against_brute_force(spark):
    rnd = random.Random(1)
    dic = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(30)}
    texts = ["".join(rnd.choice("abéc") for _ in range(40)) for _ in range(5)] + ["", "a"]
    found = {(r.id, r.start, r.end, r.surface) for r in trie.lookup(sentences(spark, *texts), words(spark, *dic), ID).collect()}
    assert found == {(i, s, s + len(w), w) for i, t in enumerate(texts) for w in dic for s in range(len(t)) if t.startswith(w, s)}
    assert trie.lookup(sentences(spark, "abc"), words(spark, "x").where("false"), ID).count() == 0


def test_encode_orders_by_count_then_value(spark):
    df = spark.createDataFrame([(v,) for v in "b b a a c  d".split(" ")], "value string")
    assert [(r.value, r["count"], r.id) for r in dictionary.encode(df).orderBy("id").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3), ("d", 1, 4)]


def test_segment_against_all_paths(spark):
    rnd = random.Random(2)
    dic = {"".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 3, 3, 4)}
    for _ in range(20):
        text = "".join(rnd.choice("abc") for _ in range(9))
        edges = [{"start": s, "end": s + len(w)} for w in dic for s in range(9) if text.startswith(w, s)]
        known = {(e["start"], e["end"]) for e in edges}
        best = min(
            sum(1 if (a, b) in known else 10 for a, b in itertools.pairwise((0, *cut, 9)))
            for k in range(9)
            for cut in itertools.combinations(range(1, 9), k)
            if all((a, b) in known or b == a + 1 for a, b in itertools.pairwise((0, *cut, 9)))
        )
        path = plain_search.cheapest(9, edges)
        assert [p[0] for p in path] == [0, *[p[1] for p in path[:-1]]] and path[-1][1] == 9
        assert sum(1 if p[2] else 10 for p in path) == best


def test_beam_finds_the_best_path_when_wide(spark):
    rnd = random.Random(3)
    for _ in range(10):
        text = "".join(rnd.choice("ab") for _ in range(6))
        edges = [{"start": s, "end": s + 2} for s in range(5) if rnd.random() < 0.6]
        known = {(e["start"], e["end"]) for e in edges} | {(s, s + 1) for s in range(6)}

        def score(path):
            codes = [plain_search.node_code(text[a:b]) for a, b in path] + [0]
            t1 = t2 = hashing.BOS_PATTERN
            total = 0
            for c in codes:
                for h in (hashing.ngram_hash(0, c), hashing.ngram_hash(1, c, t1), hashing.ngram_hash(2, c, t1, t2)):
                    total += int(search.synthetic_weight(np.array([int(h) & (1 << 20) - 1]))[0])
                t1, t2 = c, t1
            return total

        paths = [list(itertools.pairwise((0, *cut, 6))) for k in range(6) for cut in itertools.combinations(range(1, 6), k)]
        paths = [p for p in paths if all(x in known for x in p)]
        got = plain_search.beam_paths(text, edges, search.synthetic_weight, beam=1000)
        assert got[0][0] == max(map(score, paths)) == score(got[0][1])
        narrow = plain_search.beam_paths(text, edges, search.synthetic_weight, beam=2, keep=2, global_beam=3, right_check=1, right_beam=1)
        assert all(score(p) == s for s, p in narrow) and narrow[0][0] <= got[0][0]


def test_connectable(spark):
    df = spark.createDataFrame([(0, "abc", [(0, 1), (1, 3)]), (1, "abc", [(0, 1), (2, 3)]), (2, "", []), (3, "abcd", [(0, 2), (1, 4), (2, 4)])], "id int, text string, edges array<struct<start:int,end:int>>")
    assert {r.id: r.connects for r in search.with_connects(df, ID).collect()} == {0: True, 1: False, 2: True, 3: True}


def test_csv_quoting(spark):
    df = spark.createDataFrame([("test,asd",), ('test"asd',), ("plain",)], "t string")
    assert [r[0] for r in df.select(formats.csv_quoted(F.col("t"))).collect()] == ['"test,asd"', '"test""asd"', "plain"]


def test_partial_source(spark):
    df = spark.createDataFrame([(1, "# test\nもも\n\tも\tpos:b\nも&も\n")], "doc_id int, text string")
    r = source.partial_examples(df).first()
    assert (r.comment, r.surface, r.must_break, r.no_break) == ("test", "ももももも", [2, 3], [4])
    assert [(n.boundary, n.length, n.surface, [(t.field, t.value) for t in n.tags]) for n in r.nodes] == [(2, 1, "も", [("pos", "b")])]


def test_sources(spark):
    df = spark.createDataFrame([(1, 0, "# c1"), (1, 1, "a_x b_y # note"), (1, 2, "# "), (1, 3, "EOS")], "doc_id int, sent int, text string")
    assert [(r.comment, r.text) for r in source.with_comments(df).orderBy("sent").collect()] == [("c1", "a_x b_y # note"), (None, "# "), (None, "EOS")]
    found = source.gold_tokens(df.where("sent = 1"), ["f", "g", "h"]).orderBy("pos").collect()
    assert [(r.comment, r.f, r.g, r.h) for r in found] == [("note", "a", "x", None), ("note", "b", "y", None)]
    lines = spark.createDataFrame([(1, 0, "a,b"), (1, 1, "EOS"), (1, 2, 'c,"d,e"')], "doc_id int, sent int, text string")
    assert [(r.sentence, r.x, r.y) for r in source.gold_lines(lines, ["x", "y"]).orderBy("line").collect()] == [(0, "a", "b"), (1, "c", "d,e")]
    kv = spark.createDataFrame([("a:1 a:2 b",)], "t string").select(source.key_values(F.col("t"))).first()[0]
    assert [(x.k, x.v) for x in kv] == [("a", "1"), ("a", "2"), ("b", None)]


def test_confidence_weighted_learns():
    rng = np.random.default_rng(0)
    model, truth = evaluation.ConfidenceWeighted(64), rng.standard_normal(64)
    wrong = []
    for k in range(400):
        f = rng.choice(64, 6, replace=False)
        v = rng.standard_normal(6)
        v *= np.sign((truth[f] * v).sum())
        wrong.append((model.weights[f] * v).sum() <= 0)
        model.update(1.0, f, v)
    assert np.mean(wrong[-100:]) < 0.2 < np.mean(wrong[:50])
    with pytest.raises(ValueError):
        evaluation.ConfidenceWeighted(63)


def test_violation(spark):
    df = spark.createDataFrame([(0, 2, "a"), (3, 4, "a"), (1, 3, "a"), (4, 6, "a"), (0, 1, "b")], "s int, e int, t string")
    v = evaluation.violation(F.col("s"), F.col("e"), F.col("t"), F.array(F.lit(5)), F.array(F.lit(3)), F.lit("a"))
    assert [r[0] for r in df.select(v).collect()] == ["none", "word_start", "word_end", "no_boundary", "tag"]


def test_every_query_is_named_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_training_lowers_the_loss(spark):
    from latticework.operators.learning import train

    rnd = random.Random(5)
    vocabulary = ["ab", "aba", "ba", "b", "abab"]
    rows = []
    for k in range(30):
        tokens = [rnd.choice(vocabulary) for _ in range(6)]
        text, ends = "".join(tokens), list(itertools.accumulate(map(len, tokens)))
        gold = list(zip([0, *ends], ends))
        edges = sorted({(s, s + len(w)) for w in vocabulary for s in range(len(text)) if text.startswith(w, s)})
        rows.append((k, text, edges, gold))
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, text string, edges {span}, gold {span}")
    weights, losses = train(df, ID, epochs=4, batch=10)
    assert losses[-1] < 0.6 * losses[0] and weights.any()
    assert train(df, ID, epochs=2, batch=10)[1] == losses[:2]
