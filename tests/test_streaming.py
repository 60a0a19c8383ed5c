import random

import pytest
from pyspark.sql import functions as F

from chainlake.operators import chain as H
from chainlake.streaming import sync

KIND = "ledger_id string, row_no long, input_hash binary"


def batches(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def rows_of(name, n, seed=1):
    rng = random.Random(seed)
    return [(name, i, rng.randbytes(32)) for i in range(1, n + 1)]


def test_commit_stream(spark, tmp_path):
    rows = rows_of("a", 40) + rows_of("b", 25, 2)
    parts = [[r for r in rows if lo < r[1] <= hi] for lo, hi in ((0, 10), (10, 24), (24, 99))]
    path, mark = f"file://{tmp_path}/chain", f"file://{tmp_path}/mark"
    sync.commit_stream(batches(spark, tmp_path, parts), path, mark).awaitTermination()
    want = {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in H.fold(spark.createDataFrame(rows, KIND)).collect()}
    read = lambda: {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in spark.read.parquet(path).collect()}
    assert read() == want and spark.read.parquet(path).count() == len(want)
    # the same rows again, from a stream that has forgotten what it did: nothing is added
    again = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sync.commit_stream(again, path, f"{mark}-2").awaitTermination()
    assert spark.read.parquet(path).count() == len(want)
    spark.createDataFrame([("a", 7, bytes(32))], KIND).write.mode("append").parquet(f"{tmp_path}/in/forged")
    with pytest.raises(Exception, match="forked"):
        sync.commit_stream(again, path, f"{mark}-2").awaitTermination()


def test_rows_wait_for_gaps_to_close(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows_of("a", 30) + rows_of("b", 9, 2)
    shuffled = random.Random(3).sample(rows, len(rows))
    stream = batches(spark, tmp_path, [shuffled[:13], shuffled[13:20], shuffled[20:] + shuffled[:2]])
    query = sync.chain_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in H.fold(spark.createDataFrame(rows, KIND)).collect()}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in out.collect()} == want and out.count() == len(want)
    assert out.where(F.col("row_hash").isNull()).count() == 0


def test_rows_that_come_again_late(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows_of("a", 30)

    def run(parts, name):
        stream = batches(spark, tmp_path / name, parts)
        writer = sync.chain_stream(stream, recent=5).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/mark")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}/out")

    out = run([rows, [rows[3], rows[28]]], "same")
    assert out.where("row_hash is null").count() == 1 and sync.settled(out).count() == 30
    out = run([rows, [("a", 4, bytes(32))]], "forged")
    with pytest.raises(ValueError, match="another hash"):
        sync.settled(out)
    with pytest.raises(Exception, match="another hash"):
        run([rows, [("a", 29, bytes(32))]], "recent")
