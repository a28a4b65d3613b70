from pyspark.sql import functions as F

from tidemark.sources.tables import append_new
from tidemark.streaming import twins


def batches(spark, path):
    """Three files of rows whose keys repeat within and between them."""
    rows = [[(k % 7 + 5 * b, f"2024-01-{b + 1:02d} 0{k % 10}:00:00", f"{b}-{k}") for k in range(20)] for b in range(3)]
    for part in rows:
        spark.createDataFrame(part, "id long, ts string, txt string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return rows


def test_idempotent_inserts(spark, tmp_path):
    rows = batches(spark, str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = str(tmp_path / "table")
    read = lambda: sorted(map(tuple, spark.read.parquet(out).select("id", "txt").collect()))

    def run(checkpoint):
        stream = twins.read_stream(spark, str(tmp_path / "in"), schema)
        twins.appended(stream, out, "id", str(tmp_path / checkpoint)).awaitTermination(120)
        return read()

    once = run("a")
    assert [i for i, _ in once] == sorted({r[0] for part in rows for r in part})
    assert run("a") == once and run("b") == once  # nothing new, and all batches again
    append_new(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "whole"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "whole")).collect()) == [i for i, _ in once]


def test_first_occurrences(spark, tmp_path):
    rows = batches(spark, str(tmp_path / "in"))
    stream = twins.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    first = twins.first_occurrences(stream, "id", "ts", "30 days")
    twins.to_parquet(first, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got) == sorted({r[0] for part in rows for r in part}) and {r.txt for r in got} <= {r[2] for part in rows for r in part}
