"""Change sources: envelopes, snapshot differences, outbox, streams."""

import json

import pytest

from tidewright import Config, Engine, Relation, ViewSpec, count_all, max_of
from tidewright.operators.images import change_schema
from tidewright.sources import key_images, to_descriptor, to_descriptors
from tidewright.sources.catalog import table_name
from tidewright.streaming import stream_changes, stream_debezium, stream_inserts

ITEMS = "id long, category string, amount int"


def test_envelopes():
    row = {"id": 1, "category": "a"}
    envelope = {"op": "u", "before": row, "after": row, "ts_ms": 5, "source": {"table": "items", "ts_ms": 7}}
    assert to_descriptor(envelope) == {"table": "items", "operation": "update", "before": row, "after": row, "source_ts": 7}
    assert to_descriptor({"payload": envelope | {"op": "r"}})["operation"] == "create"
    assert to_descriptor(envelope | {"op": "d", "source": {"table": "x", "ts_ms": "7"}}, "items") == {"table": "items", "operation": "destroy", "before": row, "after": row}
    assert to_descriptor(None) is None
    for bad in ({"source": {"table": "t"}}, {"op": "x", "source": {"table": "t"}}, {"op": "c"}):
        with pytest.raises(ValueError):
            to_descriptor(bad)


def test_envelopes_as_a_frame(spark):
    schema = spark.createDataFrame([], ITEMS).schema
    texts = [
        {"op": "c", "after": {"id": 1, "category": None}, "source": {"ts_ms": 9}},
        {"payload": {"op": "d", "before": {"id": 2}, "source": {"ts_ms": "soon"}}},
        {"op": "u", "before": {"id": 3, "category": "a"}, "after": {"id": 3, "category": "b", "amount": 4}},
        None,
    ]
    rows = to_descriptors(spark.createDataFrame([(json.dumps(t) if t else None,) for t in texts], "value string"), schema).collect()
    assert [(r.op, r.present_before, r.present_after, r.source_ts) for r in rows] == [
        ("create", [], ["id", "category"], 9), ("destroy", ["id"], [], None), ("update", ["id", "category"], ["id", "category", "amount"], None),
    ]
    assert rows[2].after.amount == 4 and rows[0].before is None
    bad = to_descriptors(spark.createDataFrame([('{"op": "x", "after": {"id": 1}}',)], "value string"), schema)
    with pytest.raises(Exception, match="unsupported op"):
        bad.collect()


def test_key_images(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], ITEMS)
    new = spark.createDataFrame([(1, "a", 1), (2, "c", 2), (4, "d", 4)], ITEMS)
    got = {r.op: r for r in key_images(old, new, ("id",), ("category",)).collect()}
    assert got["update"].before.category == "b" and got["update"].after.category == "c" and got["update"].after.amount is None
    assert got["destroy"].before.id == 3 and got["destroy"].present_before == ["id", "category"] and got["create"].after.id == 4
    assert key_images(old, old, ("id",), ()).count() == 0


def engine(spark, tmp_path, rows, feed="external"):
    e = Engine(spark, Config(f"file://{tmp_path}/state", default_strategy="manual"))
    e.table("items", spark.createDataFrame(rows, ITEMS), ("id",))
    v = e.view(ViewSpec("v", Relation("items"), ("category",), (count_all("n"), max_of("amount", "top")), feed=feed, strategy="manual"))
    v.rebuild(True)
    return e, v


def test_outbox_relays_and_quarantines(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1), (2, "b", 2)])
    e.capture_diff("items", spark.createDataFrame([(1, "a", 9)], ITEMS), ("category",))
    e.outbox.capture("missing", spark.createDataFrame([], change_schema(e.catalog.table("items").schema)))
    assert e.drain_outbox(limit=5) == 1 and e.outbox.names() == [] and len(e.outbox.control.names("outbox/quarantine")) == 1
    v.refresh()
    assert [tuple(r) for r in v.df().collect()] == [("a", 1, 9)]
    assert e.drain_outbox() == 0


def test_failed_captures_are_tried_again_and_never_overwritten(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1)])
    rows = [key_images(spark.createDataFrame([], ITEMS), spark.createDataFrame([(k, "a", k)], ITEMS), ("id",), ("id", "category")) for k in (1, 2)]
    relayed, broken = [], [True]

    def relay(table, changes):
        if broken[0]:
            raise OSError("down")
        relayed.append([r.after.id for r in changes.collect()])

    schema = lambda table: e.catalog.table(table).schema
    for r in rows:  # two captures fail one after the other, with the queue empty in between
        e.outbox.capture("items", r)
        assert e.outbox.drain(relay, schema) == 0
    assert e.outbox.names() == [] and len(e.outbox.names("quarantine")) == 2
    broken[0] = False
    assert e.outbox.drain(relay, schema) == 2 and relayed == [[1], [2]] and e.outbox.names("quarantine") == []


def test_debezium_topics_of_several_tables(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1)])
    e.table("other_items", spark.createDataFrame([], ITEMS), ("id",))
    envelopes = [{"op": "c", "after": {"id": k, "category": "a"}, "source": {"table": t}} for k, t in ((1, "items"), (2, "OtherItems"), (3, "items"))]
    assert e.ingest_debezium(envelopes, token="t1") == 3 and [b.table for b in e.log.batches(0)] == ["items", "other_items"]
    assert e.ingest_debezium(envelopes, token="t1") == 0 and e.log.head() == 2
    texts = lambda *x: spark.createDataFrame([(y,) for y in x], "value string")
    assert e.ingest_debezium(texts(*map(json.dumps, envelopes), "null", None, '{"payload": null}'), token="t2") == -1
    counts = {b.table: e.log.rows([b], b.table, e.catalog.table(b.table).schema).count() for b in e.log.batches(2)}
    assert counts == {"items": 2, "other_items": 1}
    with pytest.raises(Exception, match="malformed envelope"):
        e.ingest_debezium(texts('{"op": "c", '), "items")
    with pytest.raises(KeyError):
        e.ingest_debezium(texts(json.dumps(envelopes[0] | {"source": {"table": "nowhere"}})))
    with pytest.raises(ValueError, match="names no table"):
        e.ingest_debezium(texts('{"op": "c", "after": {"id": 1}}'))


def test_control_files_on_other_file_systems(spark, tmp_path):
    from tidewright.store import Conflict, Control

    c = Control(spark, f"file://{tmp_path}/far")
    c.local = None  # by Hadoop's interface, as on a remote path
    c.create("a/b/1.json", {"x": 1})
    with pytest.raises(Conflict):
        c.create("a/b/1.json", {"x": 2})
    assert c.read("a/b/1.json") == {"x": 1} and c.names("a/b") == ["1.json"] and c.names("none") == []
    (tmp_path / "far" / "file").write_text("")
    with pytest.raises(Exception) as e:
        c.create("file/1.json", {})
    assert not isinstance(e.value, Conflict)


def test_inserts_survive_a_restart(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1)], feed="managed")
    spark.createDataFrame([(2, "a", 5), (3, "b", 6)], ITEMS).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in")
    stream_inserts(e, "items", feed, f"{tmp_path}/check").awaitTermination()
    again, w = engine(spark, tmp_path, [(1, "a", 1)], feed="managed")  # rebuilds
    stream_inserts(again, "items", feed, f"{tmp_path}/check").awaitTermination()
    assert sorted(tuple(r) for r in w.df().collect()) == [("a", 2, 5), ("b", 1, 6)]


def test_streams_apply_each_batch_once(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1)], feed="managed")
    new = spark.createDataFrame([(2, "a", 5), (3, "b", 6)], ITEMS)
    new.repartition(2).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_inserts(e, "items", feed, f"{tmp_path}/check").awaitTermination()
    assert sorted(tuple(r) for r in v.df().collect()) == [("a", 2, 5), ("b", 1, 6)]
    head = e.log.head()
    stream_inserts(e, "items", feed, f"{tmp_path}/check-lost").awaitTermination()  # the same batches again
    assert e.log.head() == head


def test_streams_of_changes(spark, tmp_path):
    e, v = engine(spark, tmp_path, [(1, "a", 1)])
    e.catalog.table("items").replace(spark.createDataFrame([(1, "b", 4)], ITEMS))
    spark.createDataFrame([(json.dumps({"op": "u", "before": {"id": 1, "category": "a"}, "after": {"id": 1, "category": "b"}}),)], "value string").write.text(f"{tmp_path}/json")
    feed = spark.readStream.text(f"{tmp_path}/json")
    stream_debezium(e, "items", feed, f"{tmp_path}/c1").awaitTermination()
    assert [tuple(r) for r in v.df().collect()] == [("b", 1, 4)]
    e.catalog.table("items").replace(spark.createDataFrame([], ITEMS))
    rows = key_images(spark.createDataFrame([(1, "b", 4)], ITEMS), spark.createDataFrame([], ITEMS), ("id",), ("category",))
    rows.write.parquet(f"{tmp_path}/rows")
    stream_changes(e, "items", spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows"), f"{tmp_path}/c2").awaitTermination()
    assert v.df().count() == 0


def test_names():
    assert table_name("LineItem") == "line_item" and table_name(":items") == "items" and table_name("orders") == "orders"
