import pytest
from pyspark.sql import functions as F

from latticework.operators import evaluation, learning
from latticework.operators.dictionary import field_ids
from latticework.sources import dictionary as source
from latticework.sources import text
from latticework.sources.dictionary import entries

FIELDS = {"surface": (1, "string"), "n": (3, "int"), "kinds": (2, "list")}


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "row_no long, line string")


def test_typed_fields(spark):
    found = [tuple(r) for r in entries(lines(spark, 'a,b a b,7', '"x,""y",,', "NONE,c,0,more"), FIELDS, empty="NONE").orderBy("row_no").collect()]
    assert found == [(1, "a", 7, ["a", "b"]), (2, 'x,"y', 0, []), (3, None, 0, ["c"])]
    assert entries(lines(spark, "a").where("false"), FIELDS).count() == 0


@pytest.mark.parametrize("bad, said", [("d", "line 2 has 1 columns, 3 are needed"), ("a,b,-5", "not a number: -5")])
def test_a_bad_row_ends_the_import(spark, bad, said):
    with pytest.raises(Exception, match=said):
        entries(lines(spark, "a,b,1", bad, "e,f,2"), FIELDS).collect()


def test_runs(spark):
    schema = "s int, start int, end int, tag string"
    system = spark.createDataFrame([(1, 0, 1, "N"), (1, 1, 3, "V"), (1, 3, 4, "N"), (1, 4, 6, "P"), (2, 0, 2, "N")], schema)
    gold = spark.createDataFrame([(1, 0, 1, "N"), (1, 1, 2, "N"), (1, 2, 3, "V"), (1, 3, 4, "V"), (1, 4, 6, "P"), (2, 0, 3, "N")], schema)
    found = sorted((r.s, -1 if r.run is None else r.run, r.system, r.gold, r.kind) for r in evaluation.runs(system, gold, ["s"], "tag").collect())
    assert found == [(1, 1, 1, 1, "EQUAL"), (1, 3, 1, 2, "DIFF0"), (1, 4, 1, 1, "DIFF1"), (1, 6, 1, 1, "EQUAL"), (2, -1, 1, 1, "DIFF0")]


def test_worst_is_the_first_of_the_heaviest(spark):
    m = spark.createDataFrame([(1, 5, 2), (1, 3, 2), (1, 9, 1), (2, 4, 0)], "s int, start int, w int")
    assert sorted(map(tuple, evaluation.worst(m, ["s"], "w").collect())) == [(1, 2, 3), (2, 0, 4)]


def test_unknown_values_have_ids_below_zero(spark):
    tokens = spark.createDataFrame([(1, "a"), (2, "x"), (3, "y"), (4, "y")], "k int, value string")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "value string, id long")
    assert {(r.k, r.id) for r in field_ids(tokens, known, "value").collect()} == {(1, 1), (2, -3), (3, -2), (4, -2)}


def test_annealed_beam():
    sizes = [learning.annealed_beam(r, 30, 6) for r in (0, 0.25, 0.5, 0.75, 1)]
    assert sizes[0] == 30 and sizes[-1] == 6 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("separator", [".", "|", "||", "^", "\\", "[", "]", "&", "a", " "])
def test_separators_are_no_patterns(spark, separator):
    df = spark.createDataFrame([(separator.join(["x1", "y2", "x1", "z3"]),)], "t string")
    assert df.select(source.list_field(F.col("t"), separator)).first()[0] == ["x1", "y2", "z3"]
    assert [x.k for x in df.select(text.key_values(F.col("t"), separator)).first()[0]] == ["x1", "y2", "x1", "z3"]


def test_a_number_past_an_int_is_an_error(spark):
    df = spark.createDataFrame([("99999999999",)], "t string")
    with pytest.raises(Exception, match="not a number"):
        df.select(source.int_field(F.col("t"))).collect()
