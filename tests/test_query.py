import pytest
from pyspark.sql import functions as F

from lodeline.operators import query as q


def test_parse():
    assert q.parse_query("") == []
    assert q.parse_query("level=ERR* status>=500 user.id=7 timeout") == [q.Field(("level",), q.PREFIX, "ERR"), q.Field(("status",), q.GE, "500"), q.Field(("user", "id"), q.EQ, "7"), q.Bare("timeout")]
    assert q.parse_query("msg=a=b") == [q.Field(("msg",), q.EQ, "a=b")]


REJECTED = [("a", q.EQ, "List<String>"), ("a", q.EQ, "x>y"), ("msg", q.EQ, "a>=b"), ("a", q.GT, "=b"), ("a", q.LT, "=1"), ("a", q.EQ, "b*"), ("a", q.PREFIX, "b*"), ("my key", q.EQ, "v"), ("user.id", q.EQ, "42"), ("a>b", q.EQ, "1"), ("a=b", q.EQ, "1"), ("a", q.EQ, "=x"), ("", q.EQ, "x"), ("a", q.EQ, "")]
ACCEPTED = [("level", q.EQ, "ERROR"), ("level", q.PREFIX, "ERR"), ("status", q.GE, "500"), ("msg", q.EQ, "a=b"), ("msg", q.EQ, "100%"), ("msg", q.EQ, "a.b")]


@pytest.mark.parametrize("clause", REJECTED)
def test_rejected(clause):
    assert q.build_clause(*clause) is None and q.refusal(*clause)


@pytest.mark.parametrize("clause", ACCEPTED)
def test_round_trip(clause):
    assert q.parse_query(q.build_clause(*clause)) == [q.Field((clause[0],), *clause[1:])]


def test_normalise_and_toggle():
    assert q.normalise(q.parse_query("LEVEL=x User.ID=1 zz=2"), ["Level", "level"]) == [q.Field(("Level",), q.EQ, "x"), q.Field(("User", "ID"), q.EQ, "1"), q.Field(("zz",), q.EQ, "2")]
    assert q.toggle("Level=ERROR*", "level=ERROR*", ["level"]) == ""
    assert q.toggle("x", "level=ERROR*") == "level=ERROR*"
    assert q.append_clause("a=1 ", "b=2") == "a=1 b=2"


LINES = ['{"a":"X","n":5,"f":true,"o":{"K":{"v":"Deep"}},"e":1e5}', '{"a":"xy","n":"7","z":null}', '{"a":"É"}', "plain x line", '{"a":"x"} tail', None]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a=x", [0]), ("A=x*", [0, 1]), ("n>=5", [0, 1]), ("n<6", [0]), ("f=TRUE", [0]), ("o.K.v=deep", [0]), ("o.k.v=deep", []), ("e=1e5", [0]), ("a=é", []), ("a=É", [2]), ("X", [0, 1, 3, 4]), ("x line", [3]), ("z=null", [1]), ("n>abc", []), ("", [0, 1, 2, 3, 4, 5])],
)
def test_run_filter(spark, text, want):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string")
    got = q.run_filter(lines, text, ["a", "n", "f", "o", "e", "z"])
    assert sorted(r.line_no for r in got.collect()) == want


def test_filter_from_equals_filter(spark):
    lines = spark.range(50).select(F.col("id").alias("line_no"), F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}")).alias("value"))
    whole = {r.line_no for r in q.run_filter(lines, "k>=10", ["k"]).collect()}
    part = {r.line_no for r in q.run_filter(lines, "k>=10", ["k"], from_line=30).collect()}
    assert part == {n for n in whole if n >= 30}
