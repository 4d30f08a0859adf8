from __future__ import annotations

import json

from pyspark.sql import functions as F

from bibliospark.functions import scalars

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      　"


def test_names_are_normalised_as_python_does(spark):
    names = ["Anne-Marie DuBois", "", "  ", "A  B", "İstanbul", "ΣΑΣ", "​zero width​"]
    names += [f"{c}Ab{c}cd{c}" for c in SPACES] + [f"x{c}{c}" for c in SPACES]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(scalars.normalize_name(F.col("name"))).collect()]
    assert got == [n.lower().strip() for n in names]


def test_given_name_key_is_kept(spark):
    df = spark.createDataFrame(
        [("A.M. DuBois", "anne-marie dubois"), ("A.M. DuBois", ""), ("A.M. DuBois", None)],
        "name string, given string",
    )
    got = [r[0] for r in df.select(scalars.name_key(F.col("name"), F.col("given"))).collect()]
    assert got == ["anne-marie dubois", "a.m. dubois", "a.m. dubois"]


def test_json_round_trip(spark):
    lists = [["MIT", "Stanford"], [], ["Zürich \"x\""]]
    df = spark.createDataFrame([(v,) for v in lists], "v array<string>")
    texts = df.select(scalars.array_to_json(F.col("v")).alias("t"))
    assert [json.loads(r.t) for r in texts.collect()] == lists
    back = texts.select(scalars.json_to_array(F.col("t"), "string"))
    assert [r[0] for r in back.collect()] == lists


def test_json_edges(spark):
    texts = [None, "", "[1, 2, 3]", "[1, 2", "null", "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        scalars.json_to_array(F.col("t"), "bigint"), scalars.is_malformed_json(F.col("t"), "bigint")
    ).collect()
    assert [r[0] for r in rows] == [[], [], [1, 2, 3], None, None, []]
    assert [r[1] for r in rows] == [False, False, False, True, False, False]


def test_positions_start_at_one(spark):
    df = spark.createDataFrame([(7, ["a", "b"]), (8, [])], "id bigint, names array<string>")
    rows = scalars.element_positions(df, "names", "name").collect()
    assert [tuple(r) for r in rows] == [(7, 1, "a"), (7, 2, "b")]


def test_batch_time_is_fixed_when_the_plan_is_made(spark):
    df = spark.range(3).select(scalars.batch_time().alias("t"))
    first = {r.t for r in df.collect()}
    assert len(first) == 1 and {r.t for r in df.collect()} == first
    assert first.pop().microsecond == 0


def test_only_whole_json_arrays_count(spark):
    texts = ['[1,2] junk', '[1] [2]', "['a']", '[1],"w":[2]', '[1],"v":[2]', '["a","b"]', '[]', '["}\\"{"]', " [1] ", "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        scalars.json_to_array(F.col("t"), "string").alias("v"), scalars.is_malformed_json(F.col("t"), "string").alias("bad")
    ).collect()
    assert [r.v for r in got] == [None] * 5 + [["a", "b"], [], ['}"{'], ["1"], None]
    assert [r.bad for r in got] == [True] * 5 + [False] * 5


def test_what_the_json_module_refuses_is_refused(spark):
    texts = ["[1]}", "[1]} junk", '[1]}{"x":1', '[1],"end":0}', '[1],"end":0', "[1]]", "[[1]", "[1]\n\t ", "\r\n[1]", "[1],", "[,1]", "[1,]"]
    texts += ["[1]}]", '[1]},"end":0}{"v":[2]', "[1 2]", "[01]", "\xa0[1]", "[1]\x00", "{}", '{"v":[1]}', "[1", "]", " ", "[1]//]", "[1]/**/"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t",
        scalars.json_to_array(F.col("t"), "bigint").alias("v"),
        scalars.is_malformed_json(F.col("t"), "bigint").alias("bad"),
    ).collect()

    def decoded(text):
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            return None
        return found if isinstance(found, list) else None

    assert {r.t: r.v for r in rows} == {t: decoded(t) for t in texts}
    assert {r.t: r.bad for r in rows} == {t: decoded(t) is None for t in texts}
