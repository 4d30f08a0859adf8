"""The spread forms of joins and rankings give what the plain ones give."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bibliospark.operators import graph, ids, spread


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows have key 7, another third a NULL key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50)
    return spark.range(3000).select("id", key.cast("bigint").alias("k"))


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_with_a_grouped_side_equals_plain_join(fact, dim, how):
    grouped = dim.groupBy("k").agg(F.max("v").alias("v"))
    plain = fact.join(dim, "k", how)
    joined = spread.join(fact, grouped, "k", how)
    assert joined.columns == plain.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_a_small_share_of_many_rows_is_heavy(spark):
    """A key of one row in ten thousand is found if it has more rows than a task should sort."""
    df = spark.range(2_000_000).select(
        "id", F.when(F.col("id") % 10_000 == 0, -1).otherwise(F.col("id")).alias("k")
    )
    ranked = spread.rank_within(df, "k", [F.col("id").asc()], "rank", 150)
    top = ranked.where("k = -1")
    assert top.agg(F.max("rank"), F.countDistinct("rank")).first()[:] == (200, 200)
    assert ranked.where("k <> -1").agg(F.max("rank")).first()[0] == 1


def test_key_types_must_agree(fact, dim):
    with pytest.raises(ValueError):
        spread.join(fact, dim.withColumn("k", F.col("k").cast("int")), "k")


@pytest.mark.parametrize("descending", [False, True])
def test_rank_of_heavy_keys_equals_window(fact, descending):
    value = F.pmod(F.col("id") * 7919, F.lit(100))
    order = [value.desc() if descending else value.asc(), F.col("id").asc()]
    ranked = spread.rank_within(fact, "k", order, "rank", 500)
    plain = fact.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))


def test_ids_are_dense_and_ordered(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("seq"), "id")
    rows = rows.withColumnRenamed("id", "x")
    got = ids.assign_ids(rows, ["seq"], 1000).orderBy("seq").collect()
    assert [r.id for r in got] == list(range(1001, 6001))
    assert len({r.seq for r in got}) == 5000


def test_ids_of_no_rows(spark):
    assert ids.assign_ids(spark.range(0).withColumnRenamed("id", "seq"), ["seq"], 5).count() == 0


def test_adaptive_execution_splits_a_heavy_paper(spark, tmp_path):
    """Joins of stored tables are left to Spark; a third of the edges cite one paper."""
    edges = spark.range(200_000).select(
        F.col("id").alias("citing_paper_id"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("cited_paper_id"),
    )
    edges.repartition(16).write.parquet(f"{tmp_path}/edges")
    spark.range(200_000).select("id", F.lit("t").alias("title")).write.parquet(f"{tmp_path}/papers")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = graph.cited_by(
            spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/papers")
        )
        assert len(found.collect()) == 200_000
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert "skew=true" in plan


@pytest.mark.parametrize("groups", [1, 1 << 16])
def test_keys_are_counted_one_by_one_only_in_large_groups(spark, fact, monkeypatch, groups):
    monkeypatch.setattr(spread, "KEY_GROUPS", groups)
    kept, keep = [], spread.keep
    monkeypatch.setattr(spread, "keep", lambda df, label: kept.append((label, df.columns)) or keep(df, label))
    order = [F.col("id").asc()]
    plain = fact.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    for least, heavy in [(500, True), (100_000, False)]:
        kept.clear()
        ranked = spread.rank_within(fact, "k", order, "rank", least)
        assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))
        assert kept[0] == ("heavy-groups", ["_group"]) and (("heavy-keys", ["_key"]) in kept) == heavy
