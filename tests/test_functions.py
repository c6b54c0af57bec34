"""Vector, sparse and scalar functions at their edges."""

import math

import pytest
from pyspark.sql import functions as F

from heddle.functions import scalar, sparse, vector


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_cosines(spark):
    schema = "a array<float>, b array<float>"
    assert one(spark, vector.cosine_safe("a", "b"), ([1.0, 0.0], [1.0, 1.0]), schema) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vector.cosine_safe("a", "b"), ([0.0, 0.0], [1.0, 1.0]), schema) == 0
    assert math.isnan(one(spark, vector.cosine_db("a", "b"), ([0.0, 0.0], [1.0, 1.0]), schema))
    assert one(spark, vector.dot("a", "b"), (None, [1.0]), schema) is None
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vector.dot("a", "b"), ([1.0], [1.0, 2.0]), schema)


def test_normalize_keeps_zero(spark):
    assert one(spark, vector.l2_normalize("a"), ([3.0, 4.0],), "a array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, vector.l2_normalize("a"), ([0.0, 0.0],), "a array<float>") == [0, 0]


@pytest.mark.parametrize(("text", "want"), [("[1,2.5]", [1, 2.5]), ("1, 2", [1, 2]), ("[]", []), (" [3] ", [3])])
def test_parse_dense(spark, text, want):
    assert one(spark, vector.parse_dense("t"), (text,), "t string") == want


@pytest.mark.parametrize(
    ("text", "indices", "values"),
    [
        (None, [], []),
        ("{}/30522", [], []),
        ("{}/30000", [], []),
        ("{1:0.5,7:2}/30522", [1, 7], [0.5, 2.0]),
        ("{1:a}/30522", [], []),
        ("{1,2:3}/30522", [2], [3.0]),
        ('{"indices":[3],"values":[0.25]}', [3], [0.25]),
        ('{"indices":[3', [], []),
        ('{"indices":["3"," 4"],"values":["0.25",1]}', [3, 4], [0.25, 1.0]),
        ('{"indices":[3]}', [3], []),
        ('{"values":[3]}', [], [3.0]),
        ('{"indices":["x"],"values":[3]}', [], []),
        ("", [], []),
    ],
)
def test_decode(spark, text, indices, values):
    got = one(spark, sparse.decode("t"), (text,), "t string")
    assert (got["indices"], got["values"]) == (indices, values)


def test_weights_are_sorted_by_number_and_cut(spark):
    got = one(spark, sparse.from_weights("m"), ({"10": 0.5, "9": 0.01, "2": 0.3, "3": float("nan")},), "m map<string,double>")
    assert (got["indices"], got["values"]) == ([2, 10], [0.3, 0.5])
    got = one(spark, sparse.from_weights("m"), (None,), "m map<string,double>")
    assert (got["indices"], got["values"]) == ([], [])


def test_round_trip_of_clean_vectors(spark):
    s = ([0, 5, 30521], [0.25, 1.5, 2.0])
    for write in (sparse.encode_text, sparse.encode_json):
        got = one(spark, sparse.decode(write("s")), (s,), f"s {sparse.TYPE}")
        assert (got["indices"], got["values"]) == s


@pytest.mark.parametrize("value", [0.0078125, 0.0234375, 0.5000005, 5e-7, 1.0000025, 0.1234565])
def test_decimals_are_pythons(spark, value):
    s, schema = ([1], [value]), f"s {sparse.TYPE}"
    assert one(spark, sparse.encode_text("s"), (s,), schema) == f"{{1:{value:.6f}}}/30522"
    assert one(spark, sparse.decode(sparse.encode_json("s")), (s,), schema)["values"] == [round(value, 6)]


@pytest.mark.parametrize("text", [None, "", "\t a \n", "\x1c x \x1f", " y ", "𝄞" * 3000, "a" * 2049, " " + "b " * 1500])
def test_cap_text_is_pythons(spark, text):
    assert one(spark, scalar.cap_text("t"), (text,), "t string") == (text or "").strip()[:2048]


def test_boost(spark):
    schema = "t string, p string"
    assert one(spark, scalar.boost_title("t", "p"), (" a ", " b\n"), schema) == "a\na\nb"
    assert one(spark, scalar.boost_title("t", "p"), (None, "b"), schema) == "b"
    assert one(spark, scalar.boost_title("t", "p"), (" ", None), schema) == ""


@pytest.mark.parametrize(("score", "level"), [(0.85, "very_strong_match"), (0.84, "strong_match"), (0.75, "strong_match"), (0.6, "moderate_match"), (0.45, "weak_match"), (0.1, "low_match"), (float("nan"), "low_match")])
def test_levels(spark, score, level):
    assert one(spark, scalar.match_level("s"), (score,), "s double") == level


def test_sentence_of_unknown_level(spark):
    assert one(spark, scalar.level_sentence("s"), ("none",), "s string") == scalar.UNKNOWN


def test_percent_is_pythons(spark):
    xs = [0.02675, 0.00125, 0.01005, 0.66665, 0.12345, None]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in xs], "s double").select(scalar.percent("s").alias("x")).collect()]
    assert got == [None if x is None else round(x * 100, 2) for x in xs]


def test_has_text(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",)], "t string")
    assert [r[0] for r in df.select(F.coalesce(scalar.has_text("t"), F.lit(False))).collect()] == [False, False, True]
