import datetime as dt

import pytest

from lexikv.streaming import store
from lexikv.workspace import scratch
from tests.test_commands import _model

T = dt.datetime(2024, 1, 1)


def _commands():
    rows = [(1, T, "set", "a", "x", None), (2, T, "append", "a", "y", None), (3, T, "get", "a", None, None), (4, T, "setnx", "b", "n", None), (5, T, "setnx", "b", "m", None), (6, T, "getdel", "a", None, None), (7, T, "get", "a", None, None), (8, T, "strlen", "b", None, None)]
    return rows


def _stream(spark, tmp_path, parts):
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, store.LOG_SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(store.LOG_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_counters(spark, tmp_path):
    stream = store.counters(_stream(spark, tmp_path, [_commands()[:4], _commands()[4:]]))
    q = stream.writeStream.format("memory").queryName("cnt").outputMode("complete").option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {r.cmd: r.commands for r in spark.sql("select * from cnt").collect()}
    assert out == {"set": 1, "append": 1, "get": 2, "setnx": 2, "getdel": 1, "strlen": 1}


def test_store_replies(spark, tmp_path):
    store.use_rocksdb(spark)
    try:
        stream = store.replies(_stream(spark, tmp_path, [_commands()]))
        q = stream.writeStream.format("memory").queryName("rep").outputMode("append").option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    except ImportError as e:  # the state protocol needs protobuf
        pytest.skip(str(e))
    except Exception as e:
        if "protobuf" in str(e) or "ModuleNotFoundError" in str(e):
            pytest.skip("the state protocol needs protobuf")
        raise
    out = {r.seq: r.reply for r in spark.sql("select * from rep").collect()}
    assert out == {1: "OK", 2: "2", 3: "xy", 4: "1", 5: "0", 6: "xy", 7: None, 8: "1"}


def test_apply_command_is_the_batch_model():
    rows = [r for r in _commands() if r[2] != "strlen"]
    assert [x[2] for x in _model(rows)] == ["x", "xy", "xy", "n", "n", None, None]


def test_tracker(spark):
    calls = []
    t = store.Tracker(0.2, interval=60, min_bytes=100, drop=0.1, retrain=lambda batch: calls.append(batch.count()) or True)
    frame = lambda rows: spark.createDataFrame(rows, "seq long, ts timestamp, raw long, cmp long")
    ratios = [0.5, 0.6, 0.7, 0.9, 0.9, 0.95]
    rows = [(i, T + dt.timedelta(seconds=40 * i), 100, int(100 * r)) for i, r in enumerate(ratios)]
    t(frame(rows[:3]), 0)
    t(frame(rows[:3]), 0)  # replayed
    assert t.ewma == pytest.approx(0.556)
    t(frame(rows[3:]), 1)
    e = 0.5
    for r in ratios[1:]:
        e = 0.2 * r + 0.8 * e
    assert t.ewma == pytest.approx(e)
    assert calls == [3]
    assert (t.drops, t.rises, t.bytes) == (1, 0, 0)
