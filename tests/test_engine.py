"""Maintenance, reads, verification and repair of views over small tables."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidewright import Config, Engine, Join, Relation, ViewSpec, avg_of, count_all, count_distinct, count_of, max_of, min_of, sum_of
from tidewright.policy import AlreadyRefreshing, DataDrift, NotMaterialized, RefreshError
from tidewright.store import Conflict, ViewStore, acquire

ITEMS = "id long, category string, amount int"
START = [(1, "books", 10), (2, "books", 5), (3, "games", 20), (4, None, 7)]


def make(spark, tmp_path, **config):
    return Engine(spark, Config(f"file://{tmp_path}", **{"default_strategy": "manual"} | config))


def items(spark, rows=START):
    return spark.createDataFrame(rows, ITEMS)


def totals(name="totals", **more):
    return ViewSpec(name, Relation("items"), ("category",), (count_all("n"), sum_of("amount", "total"), avg_of("amount", "mean")), **{"strategy": "manual", "buckets": 2} | more)


def tops(name="tops", **more):
    return ViewSpec(name, Relation("items"), ("category",), (max_of("amount", "top"), min_of("amount", "low"), count_distinct("amount", "k")), **{"strategy": "manual", "buckets": 2} | more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def setup(spark, tmp_path):
    e = make(spark, tmp_path)
    t = e.table("items", items(spark), ("id",), ("category", "amount"))
    return e, t


def test_delta_and_scoped_paths_converge(spark, setup):
    e, t = setup
    v, w = e.view(totals()), e.view(tops(having="top > 5"))
    v.rebuild(True), w.rebuild(True)
    t.insert(items(spark, [(5, "toys", 1), (6, "books", 100), (7, None, 3)]))
    assert v.refresh().path == "delta" and w.refresh().path == "scoped"
    t.delete("category = 'games'")
    t.update("id = 6", {"category": "'toys'"})
    t.upsert(items(spark, [(1, "books", None), (9, "new", 8)]))
    assert v.refresh().path == "delta" and w.refresh().path == "scoped"
    assert rows(v.df()) == [("books", 2, 5, 5.0), ("new", 1, 8, 8.0), ("toys", 2, 101, 50.5), (None, 2, 10, 5.0)]
    assert v.verify("full").ok and w.verify("checksum").ok
    assert not v.is_dirty() and v.refresh().path == "noop"


def test_random_writes_keep_views_equal_to_their_queries(spark, setup):
    e, t = setup
    v, w = e.view(totals()), e.view(tops())
    v.rebuild(True), w.rebuild(True)
    rng = random.Random(5)
    n = 10
    for _ in range(3):
        for _ in range(2):
            kind = rng.choice(["insert", "delete", "update"])
            if kind == "insert":
                t.insert(items(spark, [(n + i, rng.choice(["books", "games", "toys", None]), rng.randint(0, 9)) for i in range(3)]))
                n += 3
            elif kind == "delete":
                t.delete(f"id % 5 = {rng.randint(0, 4)}")
            else:
                t.update(f"id % 4 = {rng.randint(0, 3)}", {"category": rng.choice(["'books'", "null", "'x'"]), "amount": "amount + 1"})
        v.refresh(), w.refresh()
        from tidewright.plans import live

        assert rows(v.df()) == rows(live(v.spec, e.catalog.read))
        assert rows(w.df()) == rows(live(w.spec, e.catalog.read))


def test_nullable_sums_and_emptied_groups(spark, setup):
    e, t = setup
    v = e.view(ViewSpec("sums", Relation("items"), ("category",), (sum_of("amount", "total"), count_of("amount", "k")), strategy="manual"))
    v.rebuild(True)
    t.insert(items(spark, [(8, "void", None)]))
    v.refresh()
    assert v.lookup(category="void")["total"] is None
    t.delete("category = 'void'")
    assert v.refresh().path == "delta" and v.lookup(category="void") is None


def test_filtered_views_evaluate_their_predicate_on_images(spark, setup):
    e, t = setup
    v = e.view(ViewSpec("large", Relation("items", where="amount > 6"), ("category",), (count_all("n"),), strategy="manual"))
    v.rebuild(True)
    t.update("id = 2", {"amount": "50"})
    t.update("id = 3", {"amount": "1"})
    assert v.refresh().path == "delta"
    assert rows(v.df()) == [("books", 2), (None, 1)]


def test_classification(setup):
    not_null = frozenset({"category", "amount"})
    strict = ViewSpec("s", Relation("items"), ("category",), (count_all("n"), sum_of("amount", "t")))
    assert strict.strictly_self_maintainable(not_null) and not strict.strictly_self_maintainable()
    assert not totals().strictly_self_maintainable(not_null) and totals().by_delta
    assert not tops().by_delta and not totals(having="n > 1").by_delta
    assert ViewSpec("c", Relation("items"), ("category",), (count_of("amount", "n"),)).strictly_self_maintainable(not_null)
    assert not ViewSpec("d", Relation("items"), ("category",), distinct=True).strictly_self_maintainable(not_null)


def test_declarations_fail_fast():
    rel = Relation("items")
    for bad in (
        {"feed": "x"}, {"strategy": "x"}, {"mode": "x"}, {"cold_read": "x"}, {"debounce": -1}, {"max_staleness": -1}, {"buckets": 0}, {"distinct": True}, {"maintenance_keys": ("other",)}, {"depends_on": ("mv_x",)},
    ):
        with pytest.raises(ValueError):
            ViewSpec("v", rel, ("category",), (count_all("n"),), **bad)
    for name in ("category", "__n"):
        with pytest.raises(ValueError):
            ViewSpec("v", rel, ("category",), (count_all(name),))
    with pytest.raises(ValueError):
        ViewSpec("v", rel, (), ())
    with pytest.raises(ValueError):
        ViewSpec("v", rel, ("category",), (count_all("n"),), query=lambda read: read("items"))
    with pytest.raises(ValueError):
        Config("x", default_strategy="sometimes")


def test_rebuild_needs_confirmation_and_reads_never_build(spark, setup):
    e, _ = setup
    v = e.view(totals())
    with pytest.raises(ValueError):
        v.rebuild()
    assert v.count() == 3 and not v.is_materialized()
    for how, n in (("serve_stale", 0), ("read_through", 3)):
        assert e.view(totals(f"cold_{how}", cold_read=how)).df().count() == n
    with pytest.raises(NotMaterialized):
        e.view(totals("cold_raise", cold_read="raise")).df()
    with pytest.raises(NotMaterialized):
        next(v.batches())


def test_keyed_reads_populate_cold_views(spark, setup):
    e, t = setup
    v = e.view(tops())
    seen = []
    e.events.subscribe("read", lambda name, p: seen.append(p["source"]))
    assert rows(v.where(category="books")) == [("books", 10, 5, 2)]
    assert v.refresh().path == "scoped" and not v.is_warm()
    assert rows(v.where(category="books")) == [("books", 10, 5, 2)]
    t.insert(items(spark, [(5, "books", 99), (6, "games", 1)]))
    assert rows(v.where(category="books")) == [("books", 99, 5, 3)]  # not applied yet: from the source
    v.refresh()
    assert rows(v.where(category="books")) == [("books", 99, 5, 3)]
    assert seen == ["source", "cache", "source", "cache"]
    assert rows(v.stored()) == [("books", 99, 5, 3)]
    e.mark_dirty("items")
    assert v.refresh().skipped and rows(v.where(category="books")) == [("books", 99, 5, 3)] and seen[-1] == "source"


def test_cold_views_keep_held_keys_beyond_the_cap(spark, tmp_path):
    e = make(spark, tmp_path, max_tracked_keys=4)
    t = e.table("items", spark.range(60).selectExpr("id", "cast(id as string) as category", "cast(id as int) as amount"), ("id",))
    v = e.view(tops())
    held = [str(i) for i in range(0, 60, 20)]
    for k in held:
        v.where(category=k)
    assert v.refresh().path == "scoped" and not v.is_warm()
    t.update("true", {"amount": "amount + 1000"})
    assert v.refresh().path == "scoped"  # 60 changed keys, of which 3 are held
    assert rows(v.stored()) == sorted((k, int(k) + 1000, int(k) + 1000, 1) for k in held)
    assert rows(v.where(category="40")) == [("40", 1040, 1040, 1)]


def test_keyed_predicates(setup):
    v = setup[0].view(ViewSpec("two", Relation("items"), ("category", "id"), (count_all("n"),), strategy="manual"))
    assert v.keyed({"category": ["a", "b"], "id": 1}) == [("a", 1), ("b", 1)]
    assert v.keyed({"category": "a"}) is None and v.keyed({"category": None, "id": 1}) is None and v.keyed({"category": [], "id": 1}) is None


def test_finders_and_calculations(spark, setup):
    e, _ = setup
    v = e.view(totals())
    v.rebuild(True)
    assert v.first()["category"] is None and v.second()["category"] == "books" and v.last()["category"] == "games"
    assert len(v.take(2)) == 2 and v.count() == 3
    assert v.calculate(F.sum("total"), F.max("n")) == (42, 2)
    assert [len(b) for b in v.batches(2)] == [2, 1] and len(list(v.each())) == 3
    assert rows(v.where("n > 1")) == [("books", 2, 15, 7.5)] and v.where(category=["books", None]).count() == 2
    assert "total" in v.ddl()


def test_warm_up(spark, setup):
    e, _ = setup
    v = e.view(tops(warm_keys=({"category": "games"},)))
    assert v.warm_up().path == "scoped" and rows(v.stored()) == [("games", 20, 20, 1)]
    assert e.view(tops("none")).warm_up() is None
    with pytest.raises(ValueError):
        e.view(tops("bad", warm_keys=({"amount": 1},))).warm_up()


def test_joined_keys_move_with_their_dimension(spark, tmp_path):
    e = make(spark, tmp_path)
    books = e.table("books", spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 2, 50)], "id long, author_id long, pages int"), ("id",))
    authors = e.table("authors", spark.createDataFrame([(1, "US"), (2, "UK")], "aid long, country string"), ("aid",))
    rel = Relation("books", (Join("authors", "author_id = aid"),))
    v = e.view(ViewSpec("pages", rel, ("country",), (sum_of("pages", "pages"), count_all("n")), strategy="manual"))
    v.rebuild(True)
    books.update("id = 3", {"author_id": "1"})
    assert v.refresh().path == "scoped" and rows(v.df()) == [("US", 350, 3)]
    books.delete("id = 1")
    authors.update("aid = 1", {"country": "'FR'"})
    assert v.refresh().path == "scoped" and rows(v.df()) == [("FR", 250, 2)]


def test_caps_and_marks_widen(spark, tmp_path):
    e = make(spark, tmp_path, max_tracked_keys=1)
    t = e.table("items", items(spark), ("id",))
    v = e.view(tops())
    v.rebuild(True)
    t.delete("amount < 8")
    assert v.refresh().path == "widen" and rows(v.df()) == [("books", 10, 10, 1), ("games", 20, 20, 1)]
    e.mark_dirty("items")
    assert v.is_dirty() and v.refresh().path == "widen" and not v.is_dirty()
    full = e.view(tops("full", mode="full"))
    full.rebuild(True)
    t.delete("id = 3")
    assert full.refresh().path == "widen"


def test_ungrouped_views_are_rebuilt_only(spark, setup):
    e, t = setup
    v = e.view(ViewSpec("one", Relation("items"), (), (count_all("n"),), strategy="manual"))
    v.rebuild(True)
    t.delete("id = 1")
    assert v.refresh().skipped and v.is_dirty() and rows(v.df()) == [(4,)]
    v.rebuild(True)
    assert rows(v.df()) == [(3,)] and not v.is_dirty()


def external(spark, tmp_path, name="ext", **more):
    e = make(spark, tmp_path)
    t = e.table("items", items(spark), ("id",))
    v = e.view(totals(name, feed="external", **more))
    v.rebuild(True)
    return e, t, v


def test_external_feeds_recompute_and_keep_apart(spark, tmp_path):
    e, t, v = external(spark, tmp_path)
    own = e.view(totals("own"))
    own.rebuild(True)
    t.replace(items(spark, START[1:]))
    e.ingest_change("items", "destroy", before={"id": 1, "category": "books"})
    assert not own.is_dirty() and v.is_dirty()
    assert v.refresh().path == "scoped" and rows(v.where(category="books")) == [("books", 1, 5, 5.0)]
    e.ingest_change("items", "update", after={"category": "books"})
    assert v.refresh().path == "widen"
    e.ingest_change("items", "update", before={"id": 2}, after={"id": 2})  # images without the key
    assert v.refresh().path == "widen"
    e.ingest_change("items", "create", key_attributes={"category": None})  # a null key is a key
    assert v.refresh().path == "scoped"
    for bad in ({"operation": "erase"}, {"operation": "create"}, {"operation": "destroy", "key_attributes": {"category": "a"}, "source_ts": "1"}):
        with pytest.raises(ValueError):
            e.ingest("items", [bad])


def test_tokens_make_replays_harmless(spark, tmp_path):
    e, t, v = external(spark, tmp_path)
    change = [{"operation": "create", "after": {"category": "books"}}]
    assert e.ingest("items", change, "feed:1") and not e.ingest("items", change, "feed:1")
    assert e.log.head() == 1


def test_watermarks(spark, tmp_path):
    e, t, v = external(spark, tmp_path)
    report = lambda key, ts: (e.ingest_change("items", "update", key_attributes={"category": key}, source_ts=ts), v.refresh())[1]
    assert v.freshness() is None
    assert report("books", 200).keys == 1 and v.freshness() == 200
    assert report("books", 100).path == "noop"  # older than what was seen
    assert report("books", 200).keys == 1  # a tie applies
    assert report("games", 50).keys == 1 and v.freshness() == 50


def test_verification_and_repair(spark, setup):
    e, t = setup
    v = e.view(totals())
    assert v.verify().skipped == "not built" and v.reconcile().skipped
    v.rebuild(True)
    t.replace(items(spark, [(1, "books", 11), (2, "books", 5), (4, None, 7), (8, "toys", 1)]))
    assert rows(v.verify("full").drift) == [("books", "mismatched"), ("games", "extra"), ("toys", "missing")]
    assert rows(v.verify("checksum").drift) == [("books", "mismatched"), ("games", "extra"), ("toys", "missing")]
    assert rows(v.verify("row_count").drift) == [("games", "extra"), ("toys", "missing")]
    part = v.verify("full", sample=2)
    assert part.checked == 2 and part.missing == 0
    assert v.verify("full", sample=0).checked == 0 and v.verify("full", sample=1.0).missing == 1
    with pytest.raises(ValueError):
        v.verify("all")
    with pytest.raises(DataDrift):
        e.verify_all_or_raise()
    done = v.reconcile()
    assert done.repaired == 3 and v.verify().ok and v.manifest.reconciled_keys == 3
    assert e.verify_all_or_raise()[0].ok


def test_float_noise_is_no_drift(spark, tmp_path):
    e = make(spark, tmp_path)
    t = e.table("readings", spark.createDataFrame([("s", 0.1), ("s", 0.2), ("s", 0.3)], "sensor string, value double"))
    v = e.view(ViewSpec("r", Relation("readings"), ("sensor",), (sum_of("value", "total"),), strategy="manual"))
    v.rebuild(True)
    t.replace(spark.createDataFrame([("s", 0.3), ("s", 0.2), ("s", 0.1)], "sensor string, value double"))
    assert v.verify("full").ok and v.verify("checksum").ok


def test_schema_drift(spark, setup):
    e, _ = setup
    e.view(totals()).rebuild(True)
    again = Engine(spark, e.config)
    again.table("items", items(spark))
    v = again.view(ViewSpec("totals", Relation("items"), ("category",), (count_all("n"), sum_of("cast(amount as double)", "total")), strategy="manual"))
    assert set(again.schema_drift()["totals"]) == {"missing", "extra", "changed"} and v.verify().skipped == "schema drift"


def test_state_survives_a_restart(spark, setup):
    e, _ = setup
    e.view(totals()).rebuild(True)
    again = Engine(spark, e.config)
    again.table("items", items(spark))
    assert again.view(totals()).is_warm() and again.views["totals"].count() == 3


def test_writes_survive_a_restart(spark, setup):
    e, t = setup
    v = e.view(totals())
    v.rebuild(True)
    t.insert(items(spark, [(5, "toys", 1), (6, "toys", 1), (6, "toys", 1)]))
    t.update("id = 5", {"amount": "4"})
    t.delete("category = 'games'")
    want = rows(t.rows())
    again = Engine(spark, e.config)
    t2 = again.table("items", items(spark), ("id",), ("category", "amount"))
    assert rows(t2.rows()) == want
    w = again.view(totals())
    assert w.is_dirty() and w.refresh().path == "delta" and w.verify("full").ok
    t2.compact()
    t2.insert(items(spark, [(9, "new", 1)]))
    third = Engine(spark, e.config)
    t3 = third.table("items", items(spark, []), ("id",))  # the compacted rows count, not the given ones
    assert rows(t3.rows()) == rows(t2.rows())
    w = third.view(totals())
    w.rebuild(True)
    assert w.lookup(category="new").n == 1 and w.verify("full").ok
    assert rows(Engine(spark, e.config).table("items", items(spark), replay=False).rows()) == rows(items(spark))


def test_repair_counts_a_write_before_it_once(spark, setup):
    e, t = setup
    v = e.view(totals())
    v.rebuild(True)
    m = v.manifest
    broken = v.store.read(m).where("category <> 'games' or category is null").unionByName(v.store.read(m).where("category = 'games'").withColumn("n", F.lit(7).cast("long")))
    v.store.commit(v.manifest, **v.store.write(m, broken))
    verify = v.verify

    def verify_then_write(*args, **options):
        out = verify(*args, **options)
        assert out.mismatched == 1
        t.insert(items(spark, [(5, "games", 2), (6, "books", 3)]))
        return out

    v.verify = verify_then_write
    assert v.reconcile().repaired == 1
    v.verify = verify
    v.refresh()
    assert v.verify("full").ok and {r.category: (r.n, r.total) for r in v.df().collect()}["games"] == (2, 22)


def test_floating_sums_go_by_scope_and_lose_nan(spark, tmp_path):
    e = make(spark, tmp_path)
    t = e.table("f", spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 2.0)], "k string, x double"))
    v = e.view(ViewSpec("v", Relation("f"), ("k",), (sum_of("x", "total"), avg_of("x", "mean")), strategy="manual"))
    w = e.view(ViewSpec("w", Relation("f"), ("k",), (count_of("x", "n"),), strategy="manual"))
    v.rebuild(True), w.rebuild(True)
    t.delete("isnan(x)")
    assert v.refresh().path == "scoped" and w.refresh().path == "delta"
    assert rows(v.df()) == [("a", 1.0, 1.0), ("b", 2.0, 2.0)] and v.verify("full").ok


def test_cold_keys_of_every_type(spark, tmp_path):
    e = make(spark, tmp_path)
    data = spark.sql("select date'2020-01-02' d, timestamp'2020-01-02 03:04:05.678' t, cast(1.50 as decimal(9,2)) c, 1 x union all select date'2021-01-01', timestamp'2021-01-01 00:00:00', 2.25, 2")
    e.table("typed", data)
    key = data.where("x = 1").first()
    for name in ("d", "t", "c"):
        v = e.view(ViewSpec(f"by_{name}", Relation("typed"), (name,), (sum_of("x", "total"),), strategy="manual", warm_keys=({name: key[name]},)))
        assert [r.total for r in v.where(**{name: key[name]}).collect()] == [1]
        assert v.refresh().path == "scoped" and v.manifest.row_count == 1
        assert [r.total for r in v.where(**{name: key[name]}).collect()] == [1]
        assert v.warm_up().path in ("scoped", "noop")


def test_composite_scopes_outer_joins_and_narrowed_sources(spark, tmp_path):
    e = make(spark, tmp_path)
    t = e.table("items", items(spark), ("id",))
    e.table("names", spark.createDataFrame([("books", "B"), ("games", None)], "code string, label string"))
    pair = e.view(ViewSpec("pair", Relation("items"), ("category", "amount"), (max_of("id", "top"),), strategy="manual"))
    outer = e.view(ViewSpec("outer_join", Relation("items", (Join("names", "category = code", how="left"),)), ("category", "label"), (max_of("amount", "top"), count_all("n")), strategy="manual"))
    coarse = e.view(ViewSpec("coarse", Relation("items"), ("category", "amount"), (max_of("id", "top"),), maintenance_keys=("category",), strategy="manual"))
    for v in (pair, outer, coarse):
        v.rebuild(True)
    t.insert(items(spark, [(7, "books", 10), (8, "toys", None), (9, None, 7)]))
    t.delete("id = 2")
    for v in (pair, outer, coarse):
        assert v.refresh().path in ("scoped", "widen") and v.verify("full").ok, v.spec.name
    assert pair.refresh().path == "noop" and pair.verify("full", sample=2).checked == 2
    assert rows(pair.df()) == [("books", 10, 7), ("games", 20, 3), ("toys", None, 8), (None, 7, 9)]


def test_vacuum_spares_a_running_refresh(spark, setup):
    e, t = setup
    v = e.view(totals())
    v.rebuild(True)
    write = v.store.write

    def write_and_vacuum(*args):
        out = write(*args)
        assert v.store.vacuum() == 0
        return out

    v.store.write = write_and_vacuum
    v.rebuild(True)
    assert len(rows(v.df())) == 3
    assert v.store.vacuum() == 0 and len(rows(v.df())) == 3  # the first version's manifest is still kept


def test_two_writers_log_a_token_once(spark, tmp_path):
    e, other = make(spark, tmp_path), make(spark, tmp_path)
    for x in (e, other):
        x.table("items", items(spark))
    create, late = e.log.control.create, []

    def create_after_the_other(name, value):
        if not late:
            late.append(other.ingest("items", [{"operation": "create", "after": {"id": 1}}], "t"))
        return create(name, value)

    e.log.control.create = create_after_the_other
    assert not e.ingest("items", [{"operation": "create", "after": {"id": 1}}], "t") and late == [True]
    assert [b.token for b in e.log.batches(0)] == ["t"]


def test_only_one_of_two_writers_commits(spark, tmp_path):
    store = ViewStore(spark, f"file://{tmp_path}", "x", ("k",), 2)
    m = store.current()
    store.commit(m, epoch=1)
    with pytest.raises(Conflict):
        store.commit(m, epoch=2)
    now = [0.0]
    assert acquire(store, "a", 10, lambda: now[0]) and acquire(store, "b", 10, lambda: now[0]) is None
    now[0] = 11.0  # a crashed owner's lease ends
    assert acquire(store, "b", 10, lambda: now[0]).lease == "b"


def test_failures_are_kept_and_leases_freed(spark, setup):
    e, t = setup
    boom = [True]

    def before(view):
        if boom[0]:
            raise OSError("no")

    calls = []
    v = e.view(totals(before_refresh=(before,), after_refresh=(lambda view: calls.append(view.spec.name),)))
    with pytest.raises(RefreshError):
        v.rebuild(True)
    assert "no" in v.manifest.last_error and not v.is_refreshing()
    boom[0] = False
    v.rebuild(True)
    assert v.manifest.last_error is None and calls == ["totals"]
    acquire(v.store, "other", 100)
    with pytest.raises(AlreadyRefreshing):
        v.refresh()
    assert v.reconcile().deferred


def test_staleness(spark, tmp_path):
    now = [1000.0]
    e = make(spark, tmp_path, clock=lambda: now[0], staleness_budget=5.0)
    t = e.table("items", items(spark), ("id",))
    v = e.view(totals(max_staleness=lambda: 20.0))
    assert v.is_stale() and v.refresh_if_stale() is None
    v.rebuild(True)
    assert not v.is_stale()
    now[0] += 16
    assert v.is_stale() and v.refresh_if_stale().path == "noop" and not v.is_stale()
    t.delete("id = 1")
    assert v.is_stale()


def test_scheduler(spark, tmp_path):
    e = make(spark, tmp_path)
    t = e.table("items", items(spark), ("id",))
    fast, slow = e.view(totals("fast", strategy="immediate")), e.view(totals("slow", strategy="async", debounce=60))
    fast.rebuild(True), slow.rebuild(True)
    t.delete("id = 1")
    t.delete("id = 2")
    assert not fast.is_dirty() and slow.is_dirty() and e.scheduler.pending_count() == 1
    assert e.scheduler.flush() == 1 and not slow.is_dirty()
    e.scheduler.pause()
    t.delete("id = 3")
    e.scheduler.reset()
    assert e.scheduler.pending_count() == 0 and slow.is_dirty()
    done = threading.Event()
    e.events.subscribe("refresh", lambda n, p: p["view"] == "slow" and done.set())
    e.scheduler.resume()
    e.scheduler.schedule("slow", "async", 0.05)
    assert done.wait(60)


def test_fleet_operations_and_cli(spark, setup, capsys, monkeypatch):
    from tidewright import cli

    e, t = setup
    e.view(totals()), e.view(tops())
    monkeypatch.setattr(cli.importlib, "import_module", lambda name: type("M", (), {"make": staticmethod(lambda s: e)}))
    run = lambda *a: (cli.main(["m:make", *a]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    assert {r["path"] for r in run("rebuild", "--confirm")} == {"rebuild"}
    t.delete("id = 1")
    assert len(e.stale_views()) == 2 and {r["path"] for r in run("refresh-stale")} == {"delta", "scoped"}
    t.delete("id = 2")
    assert set(run("enqueue-refreshes")) == {"totals", "tops"} and not e.stale_views()
    assert [r["missing"] for r in run("verify")] == [0, 0] and run("audit") == []
    assert {r["repaired"] for r in run("reconcile")} == {0} and run("enqueue-reconciles") == [] and run("warm-up") == [None, None]
    assert {r["path"] for r in run("refresh-all")} == {"noop"}
    status = {r["view"]: r for r in e.status().collect()}
    assert status["totals"]["row_count"] == 2 and not status["tops"]["dirty"]


def test_vacuum_keeps_what_readers_may_need(spark, setup):
    e, t = setup
    v = e.view(totals())
    v.rebuild(True)
    v.store.KEPT = 2
    v.rebuild(True), v.rebuild(True)
    assert v.store.vacuum() >= 1 and rows(v.df()) == rows(v.stored()) and v.count() == 3


def test_untouched_buckets_keep_their_files(spark, setup):
    e, t = setup
    v = e.view(totals(buckets=8))
    v.rebuild(True)
    before = v.manifest.buckets
    t.update("id = 3", {"amount": "1"})
    v.refresh()
    assert sum(before[b] != p for b, p in v.manifest.buckets.items()) == 1


def test_plans_filter_below_the_aggregate(spark, setup):
    from tidewright.operators import delta, scoped

    e, t = setup
    v = e.view(tops())
    v.rebuild(True)
    frame = v._key_frame([("books",)])
    plan = scoped.recompute(v.spec, e.catalog.read, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")  # the semi-join stands below
    t.insert(items(spark, [(9, "x", 1)]))
    changes = e.log.rows(e.log.batches(0), "items", t.schema)
    text = delta.build(totals(), changes)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in text and "LogicalRDD" not in text  # the base table isn't read
