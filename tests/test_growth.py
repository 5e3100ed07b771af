"""Work that must be done once, whatever the size: jobs are not worked out again for each of their readers."""

import os

from pyspark.sql import functions as F

from reviewlake import registry
from reviewlake.functions.template import fill_template
from reviewlake.sinks import writers
from reviewlake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def counted(spark, df):
    """``df`` with its ``id`` passed through a Python function that counts the rows it sees."""
    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    return df.withColumn("id", F.udf(count, "long").asNondeterministic()("id")), seen


def test_outbox_batch_is_worked_out_once(spark, tmp_path):
    outbox = str(tmp_path / "outbox")
    rows = spark.range(0, 40, 1, 4).select("id", F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("id").alias("pr_number"),
                                           F.sha2(F.col("id").cast("string"), 256).alias("body_sha256"))
    writers.write_submissions(spark, rows.where("id < 10"), outbox, batch="a").count()
    second, seen = counted(spark, rows)
    assert writers.write_submissions(spark, second, outbox, batch="b").count() == 40
    assert seen.value == 40
    files = [f for _, _, names in os.walk(f"{outbox}/data/batch=b") for f in names if f.endswith(".parquet")]
    assert len(files) == len({os.path.basename(d) for d, _, n in os.walk(f"{outbox}/data/batch=b") if any(f.endswith(".parquet") for f in n)})


def test_arrivals_are_worked_out_once(spark):
    df, seen = counted(spark, spark.range(0, 100, 1, 4))
    base = registry._land_in_parts(df, spark, "once", F.pmod(F.xxhash64(F.col("id") % 10), F.lit(4)))
    assert sorted(r.id for r in spark.read.schema("id long").parquet(base + "/*").collect()) == list(range(100))
    assert seen.value == 100
    for i in range(4):
        assert {r[0] for r in spark.read.schema("id long").parquet(f"{base}/batch={i:03d}").select(
            F.pmod(F.xxhash64(F.col("id") % 10), F.lit(4))).collect()} <= {i}


def test_turns_are_dealt_before_they_are_cut_up(spark, tmp_path):
    turns = fx.TURNS_A_TASK * 3
    spark.range(0, turns, 1, 1).selectExpr("id AS conv_id", "1L AS turn", "'assistant' AS role", "concat('text ', id) AS text").write.parquet(
        str(tmp_path / "conversations.parquet"))
    chunks = fx.stream_chunks(spark, str(tmp_path))
    assert chunks.select(F.spark_partition_id()).distinct().count() == 3
    whole = fx.spark_sql(spark, str(tmp_path), fx.stream_chunks_sql())
    assert chunks.exceptAll(whole).count() == 0 and chunks.count() == whole.count()
    assert fx.stream_chunks(spark, SF).select(F.spark_partition_id()).distinct().count() == 1


def test_sequential_template_finds_each_place_once(spark):
    vals = ["f😀", "d {language}", "评论", "{diff}评论"]
    df = spark.createDataFrame([("代码 {reviews}{diff} {files} 😀{files}", *vals), ("x", *vals), (None, *vals), ("{language}{files}", None, *vals[1:])],
                               "t string, f string, d string, l string, r string")
    out = df.select(fill_template("t", "f", "d", "l", "r", mode="sequential").alias("p"))
    assert [r[0] for r in out.collect()] == ["代码 {diff}评论d 评论 f😀 😀{files}", "x", None, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "locate(" not in plan and plan.count("substring_index(") == 1


def test_position_window_carries_no_texts(spark):
    files = fx.derived(spark, SF, "changed_files")
    oracle_form = fx.spark_sql(spark, SF, fx.derived_cte(["changed_files"]) + "\nSELECT * FROM changed_files")
    assert files.dtypes == oracle_form.dtypes
    assert files.exceptAll(oracle_form).count() == 0 and files.count() == oracle_form.count()
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "src/" not in plan[plan.index("Window"):]
