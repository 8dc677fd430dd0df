"""Bucketed tables: their plans have no exchange on the table's side, and upserts give what the plain rule gives."""

import glob
import random

import pytest

from lemniscate.sources import buckets

SCHEMA = "id long, seq int, what string"


@pytest.fixture
def merge_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_upserts(spark, tmp_path):
    r = random.Random(5)
    names, plain = [], {}
    for k in range(3):
        rows = [(r.randrange(60) if r.random() > 0.05 else None, k * 1000 + i, f"{k}-{i}") for i in range(150)]
        batch = spark.createDataFrame(rows + rows[:5], SCHEMA)  # some rows twice
        plain |= {i: (s, w) for i, s, w in sorted((x for x in rows if x[0] is not None), key=lambda x: x[1])}
        names.append(buckets.table_name())
        if k == 0:
            buckets.write_buckets(buckets.newest(batch, "id", "seq"), "id", 6, names[0], str(tmp_path / names[0]))
        else:
            buckets.upsert_buckets(spark, names[-2], batch, "id", "seq", names[-1], str(tmp_path / names[-1]))
        got = {x.id: (x.seq, x.what) for x in spark.table(names[-1]).collect()}
        assert got == plain and spark.table(names[-1]).count() == len(plain)
        assert len(glob.glob(str(tmp_path / names[-1] / "*.parquet"))) <= 6  # a file a bucket: tasks write what they read
    same = buckets.upsert_buckets(spark, names[-1], batch.limit(0), "id", "seq", buckets.table_name())
    assert same.count() == len(plain)
    again = buckets.open_buckets(spark, str(tmp_path / names[-1]), buckets.table_name(), SCHEMA, "id", 6)
    assert {x.id: (x.seq, x.what) for x in again.collect()} == plain


def test_plans(spark, tmp_path, merge_joins):
    rows = spark.range(500).selectExpr("id", "int(id) AS seq", "'x' AS what")
    a = buckets.write_buckets(rows, "id", 6, "plans_a", str(tmp_path / "a"))
    b = buckets.write_buckets(rows.where("id % 3 = 0"), "id", 6, "plans_b", str(tmp_path / "b"))
    other = rows.where("id % 7 = 0").withColumnRenamed("what", "own").drop("seq")
    assert exchanges(a.join(b, "id")) == 0
    assert exchanges(a.join(other, "id")) == 1  # the other side's
    assert exchanges(rows.join(other, "id")) == 2
    assert exchanges(a.groupBy("id").count()) == 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say it
    assert "SelectedBucketsCount: 1 out of 6" in a.where("id = 7")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert a.join(b, "id").count() == 167
    with pytest.raises(ValueError, match="no buckets"):
        rows.write.option("path", str(tmp_path / "plain")).saveAsTable("plans_plain")
        buckets.buckets_of(spark, "plans_plain")
