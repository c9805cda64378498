import datetime as dt

from attrition.streaming.first_copy import PROVIDER, first_copies, rocksdb_state

SCHEMA = "id string, v string, o int, at timestamp"


def at(minutes):
    return dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def emitted(spark, folder, batches):
    """Rows that come out of a stream whose micro-batches are ``batches``."""

    for rows in batches:  # read in the order of their writing
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = first_copies(stream, "id", "o", "at", "10 minutes")
    assert out.columns == ["id", "v", "at"]
    before = spark.conf.get(PROVIDER, None)
    with rocksdb_state(spark):
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.conf.get(PROVIDER, None) == before
    return sorted((r.id or "-", r.v) for r in spark.read.parquet(f"{folder}/out").collect())


def test_the_least_order_stays_whenever_it_arrives(spark, tmp_path):
    got = emitted(spark, str(tmp_path), [
        [("a", "third", 3, at(0)), ("b", "only", 7, at(1)), (None, "null id, second", 2, at(1)), ("c", "no order", None, at(1))],
        [("a", "first", 1, at(4)), ("a", "second", 2, at(4)), (None, "null id, first", 1, at(4)), ("c", "ordered", 9, at(4))],
        [("d", "tie, first to come", 1, at(5)), ("a", "third again", 3, at(5))],
        [("d", "tie, later", 1, at(6))],
        [("z", "moves the watermark", 0, at(60))],
        [("b", "behind the watermark", 0, at(2)), ("z", "again", 1, at(61)), ("n", "no time", 0, None)],
        [("a", "after the state went", 5, at(80)), ("z", "while z is open", 9, at(100))],
        [("end", "never emitted", 0, at(300))],
    ])
    assert got == sorted([("a", "first"), ("a", "after the state went"), ("b", "only"), ("c", "ordered"),
                          ("d", "tie, first to come"), ("-", "null id, first"), ("z", "moves the watermark")])
