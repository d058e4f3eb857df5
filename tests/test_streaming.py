from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.streaming.ingest import compacted, ingest, stored


def test_new_files_are_added_once(spark, tmp_path):
    inbox, store, progress = (str(tmp_path / x) for x in ("inbox", "store", "progress"))
    schema = "s string, t long, v double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        ingest(stream, F.col("s"), F.col("t"), F.col("v"), store, progress).awaitTermination()
        return {(r["series_id"], r["time"]): r["value"] for r in stored(spark, store).collect()}

    assert arrive([("a", 1, 1.0), ("a", 1, 3.0), (None, 1, 9.0), ("b", 2, None)]) == {("a", 1): 2.0, ("b", 2): None}
    want = {("a", 1): 3.0, ("a", 2): 7.0, ("b", 2): None}
    assert arrive([("a", 1, 5.0), ("a", 2, 7.0)]) == want
    compacted(spark, store, f"{store}-2")
    again = stored(spark, f"{store}-2")
    assert {(r["series_id"], r["time"]): r["value"] for r in again.collect()} == want
