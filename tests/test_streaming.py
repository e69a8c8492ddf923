import datetime as dt

from tidemark.sources.tidy import SCHEMA
from tidemark.streaming import arrivals


def test_latest_and_arrivals(spark, tmp_path):
    t = dt.datetime
    rows = [(dt.date(2020, 1, 31), "a", 1.0, t(2020, 2, 1, 5)), (dt.date(2020, 2, 29), "a", 2.0, t(2020, 3, 1)), (dt.date(2019, 12, 31), "a", 3.0, t(2020, 3, 1)), (dt.date(2020, 1, 31), "b", None, t(2020, 2, 1)), (dt.date(2020, 1, 31), "b", 7.0, t(2020, 2, 1, 9))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, df, mode in (("latest", arrivals.latest_known(stream), "complete"), ("days", arrivals.arrivals(stream), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["series"], r["value"]) for r in spark.table("latest").collect()} == {("a", 2.0), ("b", 7.0)}
    assert {(r["series"], r["rows"]) for r in spark.table("days").collect()} <= {("a", 1), ("b", 2), ("a", 2)}
