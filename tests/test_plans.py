from latticework.plans.analyse import ERROR, analyse
from latticework.streaming.analyse import read_lines, write_analysed


def test_analyse(spark):
    words = spark.createDataFrame([("ab",), ("c",), ("abc",)], "surface string")
    df = spark.createDataFrame([(1, "abcab"), (2, None), (3, "x"), (4, "ab" * 10)], "id int, text string")
    found = {r.id: r.out for r in analyse(df, words, ["id"], most_bytes=10).collect()}
    assert found == {1: "abc ab", 2: ERROR, 3: "x", 4: ERROR}
    found = {r.id: r.out for r in analyse(df, words, ["id"], "morph").collect()}
    assert found[1] == "abc_dic ab_dic" and found[3] == "x_unk"


def test_stream(spark, tmp_path):
    words = spark.createDataFrame([("ab",), ("c",)], "surface string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc\ncab\nabc\n")
    q = write_analysed(read_lines(spark, str(tmp_path / "in")), words, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(r.out for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ab c", "ab c", "c ab"]  # equal lines stay
