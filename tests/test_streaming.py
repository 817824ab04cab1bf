"""Streams give what batches give."""

import json

from pyspark.sql import functions as F

from sedimenta.contracts import tree_of
from sedimenta.operators import merge as m
from sedimenta.store import VersionedTable
from sedimenta.streaming.feeds import deduplicated, landed, upsert, windowed_counts

COLUMNS = tree_of("k bigint, v bigint, h string")
DDL = "k bigint, v bigint, h string"


def test_upserts_from_landed_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(x) for x in ({"k": 1, "v": 1, "h": "a"}, {"k": 1, "v": 3, "h": "c"}, {"k": 2, "v": 1, "h": "x"})))
    table = VersionedTable(spark, str(tmp_path / "t"), COLUMNS, ["k"], buckets=2)
    spec = m.newer_and_different(list(COLUMNS), ["k"], "v", "h")
    for _ in range(2):  # the second run has nothing new
        upsert(landed(spark, str(src), DDL), table, spec, str(tmp_path / "cp"), order=lambda: [F.desc("v")]).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, 3, "c"), (2, 1, "x")] and table.version().number == 1
    (src / "b.json").write_text(json.dumps({"k": 1, "v": 2, "h": "stale"}))
    upsert(landed(spark, str(src), DDL), table, spec, str(tmp_path / "cp"), order=lambda: [F.desc("v")]).awaitTermination()
    assert table.version().number == 1


def test_windows_count_distinct_arrivals(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"id": i % 3, "at": f"2024-01-0{1 + i % 2}T00:00:0{i}Z", "kind": "a"} for i in range(6)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = landed(spark, str(src), "id bigint, at timestamp, kind string")
    out = windowed_counts(deduplicated(stream, ["id", "kind"], "at", "2 days"), "at", ["kind"], delay=None)
    q = out.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.n <= 3 for r in spark.table("counts").collect())
