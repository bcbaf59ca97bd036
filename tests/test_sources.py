"""Archives, sinks and streams on small fixtures."""

import hashlib
import io
import json
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.plans.spec import Spec
from tideline.operators.events import build_events
from tideline.operators.quality import quotes_by_day
from tideline.sources import datasets, raw, sinks
from tideline.sources.names import stem
from tideline.sources.synthetic import benchmark_table
from tideline.streaming.stateful import final_days, stream_events, stream_quality
from tideline.streaming.windows import daily_quotes


def packed(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data.csv", text)
    return out.getvalue()


def test_archives(spark, tmp_path):
    days = {
        "2024-03-01": packed("﻿update_id,bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time,event_time\n1,100,1,101,2,5,1000\n2,x,1,101,2,5,2000\n"),
        "2024-03-02": packed("3,100,1,101,2,5,90000000\n"),
    }
    asked = []

    def fetch(url):
        asked.append(url)
        return next((v for k, v in days.items() if k in url), None)

    folder = str(tmp_path / "raw")
    for _ in range(2):  # the second time, days that are there are kept
        got = raw.fetch_days(spark, fetch, "http://x/", folder, "S", "bookTicker", "2024-03-01", "2024-03-03")
    assert list(got.values()) == [True, True, False] and len(asked) == 4 and asked[0] == "http://x/bookTicker/S/S-bookTicker-2024-03-01.zip"
    with pytest.raises(FileNotFoundError, match="2024-03-03"):
        raw.complete_range(spark, folder, "S", "bookTicker", "2024-03-01", "2024-03-03")
    paths = raw.complete_range(spark, folder, "S", "bookTicker", "2024-03-01", "2024-03-02")
    q = raw.scan_quotes(spark, paths).orderBy("update_id").collect()
    assert [(r.us, r.update_id, r.bid_price, r.ask_size, r.raw_row_number) for r in q] == [(1_000_000, 1, 100.0, 2.0, 0), (2_000_000, 2, None, 2.0, 1), (90_000_000_000, 3, 100.0, 2.0, 0)]
    assert q[2].source_file == "S-bookTicker-2024-03-02.zip"
    assert raw.in_days(raw.scan_quotes(spark, paths), date(1970, 1, 2), date(1970, 1, 2)).count() == 1
    (tmp_path / "bad.zip").write_bytes(packed("update_id,bid_price,event_time\n1,2,3\n"))
    with pytest.raises(Exception, match="has no columns"):
        raw.scan_quotes(spark, [f"{tmp_path}/bad.zip"]).collect()
    with pytest.raises(ValueError, match="no archives"):
        raw.scan_quotes(spark, [])
    (tmp_path / "h.zip").write_bytes(packed("Aggregate tradeId, Price ,Quantity,First tradeId,Last tradeId,Timestamp,Was the buyer the maker\n5,2.5,3,1,1,1000,false\n"))
    h = raw.scan_trades(spark, [f"{tmp_path}/h.zip"]).first()
    assert (h.trade_id, h.price, h.us, h.buyer_is_maker) == (5, 2.5, 1_000_000, False)
    (tmp_path / "t.zip").write_bytes(packed("7,1.5,2,1,1,1000,TRUE\n8,1.5,2,1,1,1000,0\n9,1.5,,1,1,1000,maybe\n"))
    t = raw.scan_trades(spark, [str(tmp_path / "t.zip")]).orderBy("trade_id").collect()
    assert [(r.price, r.quantity, r.buyer_is_maker) for r in t] == [(1.5, 2.0, True), (1.5, 2.0, False), (1.5, None, None)]


def test_sinks(spark, tmp_path):
    target = f"{tmp_path}/table"
    sinks.write_table(spark.range(5), target)
    with pytest.raises(FileExistsError):
        sinks.write_table(spark.range(1), target)
    with pytest.raises(Exception):
        sinks.write_table(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), target, overwrite=True)
    assert spark.read.parquet(target).count() == 5
    sinks.write_table(spark.range(3), target, overwrite=True)
    assert spark.read.parquet(target).count() == 3 and [p.name for p in tmp_path.iterdir() if "staged" in p.name or "old" in p.name] == []
    rows = [(i, i * 10, s, i % 2 == 0) for i, s in enumerate(("train", "train", "validation", "test"))]
    data = spark.createDataFrame(rows, "event_id long, us long, split string, model_eligible boolean")
    with pytest.raises(ValueError, match="test"):
        sinks.write_splits(data.where("split != 'test'"), f"{tmp_path}/model", Spec())
    manifest = sinks.write_splits(data, f"{tmp_path}/model", Spec())
    assert manifest["splits"]["train"] == {"rows": 2, "first_event_id": 0, "last_event_id": 1, "start_us": 0, "end_us": 10}
    got = sinks.load_splits(spark, f"{tmp_path}/model", ("train",), ("event_id",), eligible_only=True, spec=Spec())
    assert [r.event_id for r in got["train"].collect()] == [0]
    with pytest.raises(ValueError):
        sinks.load_splits(spark, f"{tmp_path}/model", spec=Spec(embargo=60))


def test_raw_build(spark, tmp_path):
    quote, trade = packed("1,100,1,101,2,5,1000\n2,100,1,101,2,5,90000000\n"), packed("7,1.5,2,1,1,1000,TRUE\n")
    q, t = raw.build_raw(spark, lambda url: quote if "bookTicker" in url else trade, "http://x", f"{tmp_path}/zips", f"{tmp_path}/interim", "S", "1970-01-01", "1970-01-01")
    assert (q.count(), t.count()) == (1, 1)  # the other quote is of the next day
    assert sinks.exists(spark, f"{tmp_path}/interim/raw_quotes_S_1970-01-01_to_1970-01-01")
    with pytest.raises(FileNotFoundError):
        raw.build_raw(spark, lambda url: None, "http://x", f"{tmp_path}/none", f"{tmp_path}/interim", "S", "1970-01-02", "1970-01-02")


def test_names():
    assert stem("x", "S", "a", "b") == "x_S_a_to_b" and stem("x", "S", "a", "b", " v1.2 ", 10) == "x_v1.2_S_a_to_b_h10"
    for wrong in ({"tag": "a b"}, {"tag": "a/b"}, {"horizon": 0}):
        with pytest.raises(ValueError):
            stem("x", "S", "a", "b", **wrong)


def test_swap_is_undone(spark, tmp_path):
    sinks.write_table(spark.range(2), f"{tmp_path}/t")
    with pytest.raises(OSError, match="cannot put"):
        sinks.swap_in(spark, f"{tmp_path}/not-there", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_reports_compact_and_manifests(spark, tmp_path):
    table = spark.createDataFrame([("b", 10, None), ("a", 10, 0.1), ("a", 20, float("nan"))], "model string, horizon int, value double")
    paths = sinks.write_reports({"one": table, "two": table.where("horizon = 10")}, str(tmp_path), "run")
    assert (tmp_path / "run_one.csv").read_text() == "model,horizon,value\na,10,0.1\na,20,\nb,10,\n" and len(paths) == 2
    assert datasets.read_results(spark, str(tmp_path), {"m": "run"}, "two").count() == 2
    with pytest.raises(ValueError, match="expected"):
        sinks.write_compact(table, f"{tmp_path}/compact", 4)
    assert not sinks.exists(spark, f"{tmp_path}/compact") and sinks.write_compact(table, f"{tmp_path}/compact", 3) == 3
    with pytest.raises(FileExistsError):
        sinks.write_compact(table, f"{tmp_path}/compact", 3)
    found = sinks.result_manifest(spark, [f"{tmp_path}/compact", f"{tmp_path}/none"], "passed")
    sinks.write_manifest(found, f"{tmp_path}/manifest")
    assert [(r.found, r.mb is None, r.audit_status) for r in found.orderBy("position").collect()] == [(True, False, "passed"), (False, True, "passed")]
    assert "| no |" in (tmp_path / "manifest.md").read_text() and (tmp_path / "manifest.csv").read_text().startswith("position,path")


def test_records(spark, tmp_path):
    with pytest.raises(KeyError):
        with sinks.recorded_run(spark, "r", f"{tmp_path}/runs", source=str(tmp_path)) as facts:
            facts["rows"] = 4
            raise KeyError("x")
    record = json.loads(sinks.read_text(spark, f"{tmp_path}/runs/r.json"))
    assert record["status"] == "failure" and record["facts"] == {"rows": 4} and record["peak_rss_mb"] > 0 and record["source"]["commit"] is None
    with pytest.raises(RuntimeError, match="clean"):
        with sinks.recorded_run(spark, "r", f"{tmp_path}/runs", source=str(tmp_path), require_clean=True):
            pass
    (tmp_path / "a.py").write_text("1")
    first = sinks.source_sha256(str(tmp_path))
    (tmp_path / "a.py").write_text("2")
    assert first != sinks.source_sha256(str(tmp_path))
    (tmp_path / "f").write_bytes(b"x" * 3_000_000)
    assert sinks.file_sha256(spark, f"{tmp_path}/f") == hashlib.sha256(b"x" * 3_000_000).hexdigest()


def test_made_table(spark):
    a, b = (benchmark_table(spark, 4000, 5, 4).collect() for _ in range(2))
    assert a == b and 2.8 < sum(r.trade_intensity for r in a) / 4000 < 3.2 and 0.55 < sum(r.correct for r in a) / 4000 < 0.65 and min(r.relative_spread for r in a) > 0


def test_state_goes_over_batches(spark, tmp_path):
    """Events and daily quality of a stream in three batches equal those of all rows at once."""
    rng = random.Random(71)
    rows, us = [], 0
    for i in range(240):
        us += rng.randrange(1, 900_000_000)
        rows.append(("s", us, i, *[rng.choice([5.0, 6.0]) if rng.random() < 0.9 else rng.choice([float("nan"), -1.0]) for _ in range(4)]))
    schema = "symbol string, us long, update_id long, bid_price double, ask_price double, bid_size double, ask_size double"
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    whole = spark.createDataFrame(rows, schema)

    def drain(made, name, mode):
        stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return spark.table(name)

    got = drain(stream_events, "stream_events_test", "append").orderBy("event_id").collect()
    want = build_events(whole).orderBy("event_id").collect()
    assert [(r.event_id, r.us, r.update_id, r.midprice) for r in got] == [(r.event_id, r.us, r.update_id, r.midprice) for r in want]
    days = {r.utc_day: r for r in final_days(drain(stream_quality, "stream_quality_test", "update")).collect()}
    for r in quotes_by_day(whole.drop("symbol"), Spec()).collect():
        d = days[r.utc_day]
        assert (d.rows, d.invalid_rows, d.first_us, d.last_us) == (r.quote_rows, r.invalid_quotes, r.quote_start, r.quote_end) and d.max_gap_s == r.max_quote_gap


def test_daily_stream(spark, tmp_path):
    schema = "us long, update_id long, bid_price double, ask_price double, bid_size double, ask_size double"
    day = 86_400_000_000
    spark.createDataFrame([(1, 1, 1.0, 2.0, 1.0, 1.0), (2, 2, 3.0, 2.0, 1.0, 1.0), (day, 3, 1.0, 2.0, 1.0, 1.0)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = daily_quotes(stream).writeStream.outputMode("complete").format("memory").queryName("daily_quotes_test").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.rows, r.invalid_rows) for r in spark.table("daily_quotes_test").collect()) == [(1, 0), (2, 1)]
