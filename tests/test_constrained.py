"""Constrained analysis against all segmentations, lattice text, dumps and beam positions against plain loops."""

import itertools
import random

import numpy as np
import plain_search
import pytest
from pyspark.sql import functions as F

from latticework.functions import hashing, kana
from latticework.operators import formats, search, trie
from latticework.plans import constrained
from latticework.sources import text as source

ID = ["id"]
SCHEMA = "id int, surface string, must_break array<int>, no_break array<int>, nodes array<struct<boundary:int,length:int,surface:string,tags:array<struct<field:string,value:string>>>>"


def path_score(text, path):
    codes = [plain_search.node_code(text[a:b]) for a, b in path] + [0]
    t1 = t2 = hashing.BOS_PATTERN
    total = 0
    for c in codes:
        for h in (hashing.ngram_hash(0, c), hashing.ngram_hash(1, c, t1), hashing.ngram_hash(2, c, t1, t2)):
            total += int(search.synthetic_weight(np.array([int(h) & (1 << 20) - 1]))[0])
        t1, t2 = c, t1
    return total


def cost(span, kind, must, never, nodes):
    a, z = span
    if a in never or z in never or any(a < b < z for b in must):
        return constrained.BOUNDARY_PENALTY
    for n in nodes:
        if n[0] == a:
            if n[1] != z - a:
                return constrained.BOUNDARY_PENALTY
            return constrained.TAG_PENALTY if any(kind != v for _, v in n[3] or ()) else 0
    return 0


def test_constrained_paths_against_all_segmentations(spark):
    rnd = random.Random(5)
    dic = {w: rnd.choice(("noun", "verb")) for w in ("a", "ab", "ba", "bab", "aab", "bb", "abba")}
    rows = []
    for i in range(30):
        text = "".join(rnd.choice("ab") for _ in range(rnd.choice((0, 1, 3, 6, 8))))
        some = lambda: sorted(rnd.sample(range(1, max(len(text), 2)), min(len(text) - 1, rnd.randint(0, 2)))) if len(text) > 1 else []  # noqa: B023, E731
        node = [(s, n, text[s : s + n], [("kind", rnd.choice(("noun", "verb")))] * rnd.randint(0, 1)) for s in some()[:1] for n in (rnd.randint(1, 2),)]
        rows.append((i, text, some(), some(), node))
    words = spark.createDataFrame(list(dic.items()), "surface string, kind string")
    found = {}
    for r in constrained.constrained_paths(spark.createDataFrame(rows, SCHEMA).repartition(3), words, ID, ("kind",), keep=1, beam=300).collect():
        found.setdefault(r.id, [r.score]).append((r.start, r.end))
    for i, text, must, never, nodes in rows:
        n, best = len(text), None
        for k in range(n):
            for cut in itertools.combinations(range(1, n), k):
                path = list(itertools.pairwise((0, *cut, n)))
                if all(z - a == 1 or text[a:z] in dic for a, z in path):
                    score = path_score(text, path) + sum(cost(s, dic.get(text[s[0] : s[1]]), must, never, nodes) for s in path)
                    best = max(best or (score, path), (score, path), key=lambda x: x[0])
        if n:
            assert found[i][0] == best[0] and sum(cost(s, dic.get(text[s[0] : s[1]]), must, never, nodes) for s in found[i][1:]) + path_score(text, sorted(found[i][1:])) == best[0]
        else:
            assert i not in found


def test_partial_lines_are_kept(spark):
    df = spark.createDataFrame([(1, "ab\nc&d\n\tef\tkind:x\ngh")], "doc_id int, text string")
    examples = source.partial_examples(df).withColumnRenamed("doc_id", "id").drop("comment")
    words = spark.createDataFrame([("abcd", "y"), ("ef", "x"), ("efgh", "y"), ("cd", "y")], "surface string, kind string")
    paths = constrained.constrained_paths(examples, words, ID, ("kind",), keep=1).orderBy("pos").collect()
    assert [r.surface for r in paths if r.start >= 2][:2] == ["cd", "ef"] and paths[0].start == 0 and {2, 4, 6} <= {r.end for r in paths}


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(4)
    dic = ["ab", "abc", "bc", "c", "ca", "cab"]
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 4, 7, 12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return texts, dic, trie.with_edges(rows, spark.createDataFrame([(w,) for w in dic], "surface string"), ID)


def test_numbered_nodes_and_lattice_text(spark, small):
    texts, dic, lattices = small
    paths = search.n_best(lattices, ID, keep=3, beam=4, details=True)
    per = {}
    for r in paths.collect():
        per.setdefault(r.id, {}).setdefault(r["rank"], []).append((r.start, r.end, r.own, r.score))
    nodes = search.numbered_nodes(paths, ID)
    got = {(r.id, r.node): (r.before, r.start, r.end, r.own, r.ranks) for r in nodes.collect()}
    for i, by_rank in per.items():
        spans = sorted({s[:2] for p in by_rank.values() for s in p})
        for p in by_rank.values():
            p.sort()
            codes = [s[:2] for s in p]
            assert sum(s[2] for s in p) <= p[0][3] + 3000 and path_score(texts[i], codes) == p[0][3]
        for k, span in enumerate(spans, 1):
            prior = {0 if j == 0 else spans.index(p[j - 1][:2]) + 1 for p in by_rank.values() for j in range(len(p)) if p[j][:2] == span}
            ranks = sorted(r for r, p in by_rank.items() if span in [s[:2] for s in p])
            own = max(s[2] for p in by_rank.values() for s in p if s[:2] == span)
            assert got[i, k] == (";".join(map(str, sorted(prior))), *span, own, ";".join(map(str, ranks)))
    none = {n: F.lit(None).cast("string") for n in ("subpos", "conjtype", "conjform", "features", "canonical", "base", "reading")} | {f"{n}_id": F.lit(0) for n in ("subpos", "conjtype", "conjform")}
    named = nodes.withColumns(none | {"pos": F.lit("noun"), "pos_id": F.lit(6), "flags": F.lit(kana.DELETE | kana.DELETE_LAST)})
    out = {r.id: r.out.split("\n") for r in formats.lattice_text(named, paths.select("id", "rank", "score"), ID).collect()}
    first = out[3][1].split("\t")
    assert len(first) == 18 and first[:5] == ["-", "1", "0", "0", str(got[3, 1][2] - 1)] and first[9:11] == ["noun", "6"] and "非標準表記:DL|" in first[17] and first[17].endswith("ランク:" + got[3, 1][4])
    assert out[3][0].startswith(f"# MA-SCORE\trank1:{per[3][1][0][3]} rank2:") and out[3][-2:] == ["EOS", ""]


def test_dump_and_beam_positions(small):
    texts, dic, lattices = small
    dump = search.dumped(lattices, ID, beam=2, global_beam=3)
    rows = dump.collect()
    best = {r.id: r for r in rows if r.best and r.end == len(texts[r.id]) + 1}
    top = {r.id: r.score for r in search.n_best(lattices, ID, keep=1, beam=2, global_beam=3).collect()}
    assert {i: r.total for i, r in best.items()} == top
    assert all(sum(1 for x in rows if (x.id, x.start, x.end) == (r.id, r.start, r.end)) <= 2 for r in rows)
    for r in search.beam_positions(dump, ID).collect():
        ending = sorted(((x.total, x.start, -x.place, x.surface) for x in rows if x.id == r.id and x.end == r.boundary), reverse=True)
        assert ending[r.position][0] == r.score and ending[r.position][3] == r.surface and (ending[0][3], ending[0][0]) == (r.leader, r.leader_score)


def test_running_ends_of_very_many_words(spark):
    df = spark.createDataFrame([(1, ["ab"] * 20000), (2, []), (3, ["日本", "x"]), (4, None)], "id int, w array<string>").repartition(2)
    found = {r.id: r.e for r in df.select("id", source.running_ends("w").alias("e")).collect()}
    assert found[1][-1] == 40000 and found[2] == [] and found[3] == [2, 3] and found[4] == []


def test_flag_letters(spark):
    df = spark.createDataFrame([(0,), (kana.REPLACE | kana.REPLACE_PROLONG | kana.E_ROW,), (kana.DELETE | kana.DELETE_TSU | kana.DELETE_LAST,), (kana.REPLACE | kana.REPLACE_SMALL | kana.DELETE | kana.DELETE_PROLONG | kana.DELETE_SMALL,)], "f int")
    assert [r[0] for r in df.select(formats.flag_suffix(F.col("f"))).collect()] == ["", "非標準表記:Rpe", "非標準表記:DHL", "非標準表記:RsDPS"]


def test_lattice_text_searches_once(spark, small, tmp_path):
    """No table of nodes is sent to all tasks or joined, and paths are searched once for a sentence."""
    texts, dic, lattices = small
    paths = search.n_best(lattices, ID, keep=3, beam=4, details=True)
    none = {n: F.lit(None).cast("string") for n in ("subpos", "conjtype", "conjform", "features", "canonical", "base", "reading")} | {f"{n}_id": F.lit(0) for n in ("subpos", "conjtype", "conjform")}
    named = search.numbered_nodes(paths, ID).withColumns(none | {"pos": F.lit("noun"), "pos_id": F.lit(6), "flags": F.lit(0)})
    once = formats.lattice_text(named, None, ID)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("search(") == 1 and "Join" not in plan
    given = formats.lattice_text(named, paths.select("id", "rank", "score"), ID)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, given.collect())) and once.count() == len(texts)
