from __future__ import annotations

from caselens.operators.search import SearchQuery
from caselens.streaming import tail


def test_live_search_and_timeline(spark, tmp_path):
    rows = [(k, f"2026-01-01 00:{k:02d}:00", "error" if k % 2 else "view") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: tail.read(spark, str(tmp_path / "in"), df.schema)
    q = tail.to_folder(tail.live_search(read(), SearchQuery("error")).select("id", "kind"), str(tmp_path / "hits"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 30
    q = tail.live_timeline(read(), "ts", 600).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["count"] for r in spark.sql("select * from live").collect()) == [10] * 6
    q = tail.live_counts(read(), "kind", "ts", 3600).writeStream.format("memory").queryName("kinds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.value: r["count"] for r in spark.sql("select * from kinds").collect()} == {"error": 30, "view": 30}
