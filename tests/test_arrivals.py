"""The streams of the registered queries arrive in lots that many tasks write."""

from pyspark.sql import functions as F

from pagelake.plans.job_queries import _arriving


def test_lots_are_micro_batches_of_their_own_in_order(spark, tmp_path):
    found = []

    def step(batch, version):
        got = batch.select("id", F.input_file_name().alias("file")).collect()
        found.append((version, {r["id"] % 2 for r in got}, len(got), len({r["file"] for r in got})))

    for stream in _arriving(spark, spark.range(400).repartition(4), (F.col("id") % 2).cast("int"), "lots", 2):
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert found == [(0, {0}, 200, 4), (1, {1}, 200, 4)]
