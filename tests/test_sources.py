"""Readers and sinks on temporary files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemniscate.sources import readers, sinks
from lemniscate.streaming import ingest

HEAD = "id\tpost_id\tthread_id\ttype\tcomment_id\told_visual_id\tvisual_id\tissue\tformula\n"


def test_shards(spark, tmp_path):
    (tmp_path / "1.tsv").write_text(HEAD + '1\tp\tt\tq\t\t\tv1\t\t"a\tb"\n2\tp\tt\tq\t\t\tv2\td\tx\nshort\trow\n')
    rows = {r.id: r for r in readers.formula_shards(spark, str(tmp_path)).collect()}
    assert rows["1"].formula == "a\tb" and rows["2"].issue == "d" and set(rows) == {"1", "2"}
    assert readers.formula_lines(spark, str(tmp_path)).count() == 2


def test_judgments_and_runs(spark, tmp_path):
    (tmp_path / "q").write_text("1\t0\ta\t1\n1\t0\ta\t3\n1\t0\tb\tx\nbad\n")
    assert [tuple(r) for r in readers.qrels(spark, str(tmp_path / "q")).collect()] == [("1", "a", 3)]
    (tmp_path / "r").write_text("1 Q0 a 1 0.5 tag\n1  Q0\tb 2 0.25 tag\nshort line\n")
    run = readers.trec_run(spark, str(tmp_path / "r"))
    assert [(r.doc_id, r.rank, r.score) for r in run.orderBy("rank").collect()] == [("a", 1, 0.5), ("b", 2, 0.25)]
    sinks.write_trec(run, str(tmp_path / "out"), "t")
    assert readers.trec_run(spark, str(tmp_path / "out")).exceptAll(run).count() == 0


def test_topics_and_json(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<Topics><Topic number="B.1"><Formula_Id>q_1</Formula_Id><Latex>x</Latex><Title>t</Title><Question>q</Question><Tags>a</Tags></Topic></Topics>')
    row = readers.topics(spark, str(tmp_path / "t.xml")).first()
    assert (row.query_id, row.formula_id, row.latex) == ("B.1", "q_1", "x")
    (tmp_path / "m.json").write_text('{"B.1": {"a": 1}, "B.2": {"b": 0}}')
    assert readers.json_map(spark, str(tmp_path / "m.json"), T.MapType(T.StringType(), T.IntegerType())).count() == 2
    named = readers.with_topic_alias(spark.createDataFrame([("1",), ("B.2",), ("9",)], "id string"), spark.createDataFrame([("B.1",), ("B.2",)], "qid string"), "id")
    assert {(r.id, r.matched_qid) for r in named.collect()} == {("1", "B.1"), ("B.2", "B.2"), ("9", None)}


def test_resume(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "k")
    assert sinks.append_missing(rows, str(tmp_path / "i"), "k") == 5
    assert sinks.append_missing(spark.range(8).withColumnRenamed("id", "k"), str(tmp_path / "i"), "k") == 3
    assert spark.read.parquet(str(tmp_path / "i")).count() == 8


def test_visual_id_and_text(spark):
    row = spark.createDataFrame([("Q_6 ", "", "b")], "v string, n string, l string").select(readers.visual_id(F.col("v")).alias("v"), readers.latex_of(F.col("n"), F.col("l")).alias("t")).first()
    assert (row.v, row.t) == ("6", "b")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text(HEAD + "1\tp\tt\tq\t\t\tv1\t\t$x$\n2\tp\tt\tq\t\t\tv2\td\ty\n")
    for _ in range(2):
        q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.formula_id, r.latex_norm) for r in rows] == [("1", "x")]


def test_two_columns_ids_and_features(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('1\tx "y\n2\n3\tz\n')
    rows = readers.two_columns(spark, str(tmp_path / "t.tsv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", 'x "y'), ("3", "z")]
    (tmp_path / "f.json").write_text('{"id": "1", "latex": "a"}\n{"id": "2", "latex": "b"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("latex", T.StringType())])
    found = readers.rows_of_ids(readers.json_lines(spark, str(tmp_path / "f.json"), schema), spark.createDataFrame([("2",), ("9",), ("2",)], "id string"))
    assert [tuple(r) for r in found.collect()] == [("2", "b")]
    sinks.write_features(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, None, 0)], "qid int, features array<float>, label long"), str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert dict(back.dtypes) == {"qid": "int", "features": "array<double>", "label": "int"} and back.count() == 2


def test_raw_vectors(spark, tmp_path):
    """Several files, one of many splits, one empty; positions go on from file to file and meet the id map."""
    old = spark.sparkContext._jsc.hadoopConfiguration().get("fs.local.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.local.block.size", "1000")  # splits that rows of 12 bytes don't fill
    try:
        want = np.arange(3 * 1002, dtype="<f4").reshape(-1, 3) / 7
        names = []
        for i, (low, high) in enumerate([(0, 1000), (1000, 1000), (1000, 1002)]):
            (tmp_path / f"{i}").mkdir()
            want[low:high].tofile(tmp_path / f"{i}" / "v.bin")
            names.append(str(tmp_path / f"{i}" / "v.bin"))
        rows = readers.raw_vectors(spark, names, 3)
        assert rows.rdd.getNumPartitions() > 4
        got = rows.orderBy("position").collect()
        assert [r.position for r in got] == list(range(1002))
        assert np.array_equal(np.array([r.embedding for r in got], "<f4"), want)
        ids = readers.id_map(spark.createDataFrame([([f"d{i}" for i in range(1002)],)], "ids array<string>"), "ids")
        assert rows.join(ids, "position").where("position = 1001").first().id == "d1001"
        assert readers.raw_vectors(spark, names[1], 3).count() == 0 and readers.raw_vectors(spark, [], 3).count() == 0
        with pytest.raises(ValueError, match="no rows of 7"):
            readers.raw_vectors(spark, names[0], 7)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.local.block.size", old or str(32 << 20))
