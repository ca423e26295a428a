"""One view: maintenance, reads, verification, repair."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .functions.keys import key_filter, key_of, key_text, same_keys
from .operators import delta, scoped, verify
from .plans.compile import create_table_ddl, live, live_state, schema_drift, shown
from .plans.spec import ViewSpec
from .policy import AlreadyRefreshing, DataDrift, NotMaterialized, ReconcileResult, RefreshError, RefreshResult, stale
from .store import Manifest, ViewStore, acquire


class View:
    def __init__(self, engine, spec: ViewSpec):
        self.engine, self.spec, self.spark = engine, spec, engine.spark
        self.store = ViewStore(engine.spark, engine.config.state_dir, spec.name, spec.scope, spec.buckets)
        self._resident: tuple[dict, DataFrame] | None = None

    # ---- state

    @property
    def manifest(self) -> Manifest:
        return self.store.current()

    def is_warm(self) -> bool:
        return self.manifest.warm

    def is_materialized(self) -> bool:
        return bool(self.manifest.schema)

    def is_refreshing(self) -> bool:
        m = self.manifest
        return bool(m.lease) and m.lease_until > self.engine.config.clock()

    def pending_batches(self, m: Manifest | None = None):
        """Log entries that the view has not applied: its tables, fed the way it is fed."""
        m = m or self.manifest
        return [b for b in self.engine.log.batches(m.applied_seq) if b.table in self.spec.depends_on and (b.widen or b.origin == self.spec.feed)]

    def is_dirty(self) -> bool:
        m = self.manifest
        return m.forced or not m.warm and not m.refreshed_at or bool(self.pending_batches(m))

    def max_staleness(self) -> float | None:
        own = self.spec.max_staleness() if callable(self.spec.max_staleness) else self.spec.max_staleness
        return own if own is not None else self.engine.config.default_max_staleness

    def is_stale(self) -> bool:
        m, c = self.manifest, self.engine.config
        times = [t for t in (m.refreshed_at, m.reconciled_at) if t]
        return stale(max(times) if times else None, self.is_dirty(), self.max_staleness(), c.staleness_budget, c.clock())

    def freshness(self) -> int | None:
        """The oldest source timestamp up to which every known key is applied."""
        m = self.manifest
        return self._watermarks(m).agg(F.min("source_ts")).first()[0] if m.watermarks else None

    # ---- maintenance

    def rebuild(self, confirm: bool = False) -> RefreshResult:
        """Builds the whole view anew; the only full read of the tables that is ever implied."""
        if not confirm:
            raise ValueError("rebuild reads all of the view's tables; call it with confirm=True")
        return self._cycle(self._rebuild)

    def refresh(self) -> RefreshResult:
        """Applies what changed since the last time, by the cheapest plan that is right."""
        return self._cycle(self._maintain)

    def refresh_if_stale(self) -> RefreshResult | None:
        return self.refresh() if self.is_materialized() and self.is_stale() else None

    def _cycle(self, work) -> RefreshResult:
        owner, clock = uuid.uuid4().hex, self.engine.config.clock
        m = acquire(self.store, owner, self.engine.config.lease_seconds, clock)
        if m is None:
            raise AlreadyRefreshing(self.spec.name)
        began = clock()
        try:
            for f in self.spec.before_refresh:
                f(self)
            path, changes, keys = work(m)
            now = clock()
            done = {"lease": None, "lease_until": 0.0, "last_error": None}
            if path != "skipped":
                done |= {"refreshed_at": now, "duration_ms": (now - began) * 1000}
            new = self._commit(m, changes | done)
            for f in self.spec.after_refresh:
                f(self)
        except Exception as e:
            text = f"{type(e).__name__}: {e}"[:1000]
            self.store.update(lambda x: {"lease": None, "lease_until": 0.0, "last_error": text} if x.lease == owner else {})
            self.engine.events.emit("refresh", lambda: {"view": self.spec.name, "path": "failed", "error": text})
            raise RefreshError(f"{self.spec.name}: {text}") from e
        result = RefreshResult(self.spec.name, path, new.row_count, (clock() - began) * 1000, new.refreshed_at, keys)
        self.engine.events.emit("refresh", lambda: {"view": self.spec.name, "path": path, "row_count": result.row_count, "duration_ms": result.duration_ms})
        return result

    def _commit(self, m: Manifest, changes: dict) -> Manifest:
        """One commit of data and log position. Keys that readers asked for meanwhile stay."""

        def merged(now: Manifest) -> dict:
            if (now.version, now.epoch, now.lease) != (m.version, m.epoch, m.lease):
                raise RuntimeError("the view's lease was lost")
            late = tuple(k for k in now.pending if k not in m.pending)
            return changes | {"pending": changes.get("pending", m.pending) + late}

        return self.store.update(merged)

    def _rebuild(self, m: Manifest):
        head, read = self.engine.catalog.snapshot()
        written = self.store.write(m, live_state(self.spec, read))
        return "rebuild", written | {"warm": True, "applied_seq": head, "fresh": None, "pending": (), "forced": False, "epoch": m.epoch + 1}, None

    def _maintain(self, m: Manifest, broken: list[tuple] = ()):
        """Applies the log up to its head, and recomputes the keys in ``broken`` with it."""
        spec, log = self.spec, self.engine.log
        head, read = self.engine.catalog.snapshot()
        todo = [b for b in log.batches(m.applied_seq, head) if b.table in spec.depends_on and (b.widen or b.origin == spec.feed)]
        asked = [*dict.fromkeys([*map(key_of, m.pending), *broken])]
        if not todo and not asked and not m.forced:
            return ("noop" if m.warm or m.refreshed_at else "skipped"), {"applied_seq": head}, None
        if not spec.grouped and spec.mode != "full" and not m.forced:
            return "skipped", {}, None  # only a rebuild can bring it up to date
        changes = {t: rows for t in spec.depends_on if (rows := log.rows(todo, t, self.engine.catalog.table(t).schema)) is not None}
        widen = m.forced or any(b.widen for b in todo) or spec.mode == "full" and bool(todo)
        if not widen and m.warm and not asked and spec.feed == "managed" and self.by_delta():
            return self._by_delta(m, changes, head)
        keys = None
        if not widen:
            keys, marks = self._keys(m, changes, read, asked)
            widen = keys is None
        if widen:
            if m.warm:
                return "widen", self._rebuild(m)[1], None
            # a cold view can't be recomputed as a whole: what it held is forgotten
            return "skipped", {"applied_seq": head, "epoch": m.epoch + 1, "fresh": None, "forced": False, "pending": ()}, None
        n = len(keys)
        new = {"applied_seq": head, "pending": ()} | ({"watermarks": marks} if marks else {})
        if not n:
            return "noop", new, 0
        frame = self._key_frame(keys)
        if m.warm or m.schema:
            touched = self.store.buckets_of(frame)
            kept = scoped.without(self.store.read(m, touched), frame, spec.scope)
            fresh_rows = scoped.recompute(spec, read, frame)
            new |= self.store.write(m, kept.unionByName(fresh_rows.select(*kept.columns)), touched)
        else:
            new |= self.store.write(m, scoped.recompute(spec, read, frame))
        if not m.warm:
            new |= {"fresh": self._with_fresh(m, frame)}
        self.engine.events.emit("maintenance", lambda: {"view": spec.name, "path": "scoped", "keys": n})
        return "scoped", new, n

    def by_delta(self) -> bool:
        """Can signed changes keep the view exactly? Sums and averages of floating numbers can't:
        a NaN never leaves a sum, and rounding adds up."""
        if not self.spec.by_delta:
            return False
        summed = [a.arg for a in self.spec.aggs if a.kind in ("sum", "avg")]
        shape = replace(self.spec.relation, where=None).build(self.engine.catalog.read)
        return not any(isinstance(shape.select(F.expr(x)).schema[0].dataType, (T.FloatType, T.DoubleType)) for x in summed)

    def _by_delta(self, m: Manifest, changes: dict[str, DataFrame], head: int):
        spec = self.spec
        summed = delta.build(spec, changes[spec.relation.table])
        path = self.store.data_path("deltas")
        touched = self.store.write_by_bucket(summed, path)  # a row per changed group
        held = self.spark.read.schema(summed.schema).parquet(path)
        self.engine.events.emit("maintenance", lambda: {"view": spec.name, "path": "delta", "keys": held.count()})
        if not touched:
            return "noop", {"applied_seq": head}, 0
        new = self.store.write(m, delta.apply(spec, self.store.read(m, touched), held), touched)
        self.store.control.remove(path.removeprefix(f"{self.store.control.root}/"))
        return "delta", new | {"applied_seq": head}, None

    def _keys(self, m: Manifest, changes: dict[str, DataFrame], read, asked: list[tuple]):
        """(key tuples, watermark folder) to recompute; (None, None) to widen."""
        spec, found, unclear = self.spec, [], []
        for table in changes:
            got = scoped.affected(spec, table, changes, read)
            if got is None:
                return None, None
            keys, partial = got
            found.append(keys)
            if partial is not None:
                unclear.append(partial)
        cap = self.engine.config.max_tracked_keys
        marks, tuples = None, []
        if found:
            every = reduce(lambda a, b: a.unionAll(b), found)
            grouped = every.groupBy(*spec.scope).agg(F.max("source_ts").alias("source_ts"))
            if spec.feed == "external":
                grouped, marks = self._suppressed(m, grouped)
            if not m.warm:  # a cold view only keeps what it holds
                held = self.spark.read.parquet(m.fresh) if m.fresh else self._key_frame([])
                grouped = grouped.join(held, same_keys(grouped, held, spec.scope), "left_semi")
            rows = grouped.limit(cap + 1).select(*spec.scope, F.lit(False))
            nulls = [F.lit(None).cast(f.dataType) for f in rows.schema[: len(spec.scope)]]
            for images in unclear:  # one of them is enough to widen; asked in the same job
                rows = rows.unionAll(images.limit(1).select(*nulls, F.lit(True)))
            got = rows.collect()  # at most cap + 1 keys and a row per table
            if any(r[-1] for r in got):
                return None, None
            tuples = [tuple(r)[:-1] for r in got]
        tuples = list(dict.fromkeys([*tuples, *asked]))
        return (None, None) if len(tuples) > cap else (tuples, marks)

    def _watermarks(self, m: Manifest) -> DataFrame | None:
        return self.spark.read.parquet(m.watermarks) if m.watermarks else None

    def _suppressed(self, m: Manifest, keys: DataFrame):
        """Keys whose stored watermark isn't newer than the change, and the new watermarks."""
        scope, old = self.spec.scope, self._watermarks(m)
        if old is None:
            stamped = keys.where("source_ts is not null")
            if not stamped.limit(1).count():
                return keys, None
            live_keys, merged = keys, stamped
        else:
            both = keys.join(old.withColumnRenamed("source_ts", "__seen").toDF(*(f"__{k}" for k in scope), "__seen"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in scope], "left")
            live_keys = both.where("source_ts is null or __seen is null or source_ts >= __seen").select(*scope, "source_ts")
            merged = old.select(*scope, "source_ts").unionAll(keys.where("source_ts is not null")).groupBy(*scope).agg(F.max("source_ts").alias("source_ts"))
        path = self.store.data_path("watermarks")
        merged.write.parquet(path)
        return live_keys, path

    def _key_types(self) -> T.StructType:
        whole = live_state(self.spec, self.engine.catalog.read).schema
        return T.StructType([T.StructField(k, whole[k].dataType, True) for k in self.spec.scope])

    def _key_frame(self, tuples: list[tuple]) -> DataFrame:
        """At most ``max_tracked_keys`` rows; a local relation, which is broadcast and projected
        without a job. Timestamps keep the conversion of plain rows."""
        types = self._key_types()
        if any(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) for f in types):
            return self.spark.createDataFrame(tuples, types)
        columns = list(zip(*tuples, strict=True)) if tuples else [()] * len(types)
        arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, types, strict=True)]
        return self.spark.createDataFrame(pa.Table.from_arrays(arrays, types.fieldNames()), schema=types)

    def _fresh(self, m: Manifest) -> set[tuple]:
        return {tuple(r) for r in self.spark.read.parquet(m.fresh).collect()} if m.fresh else set()

    def _with_fresh(self, m: Manifest, keys: DataFrame) -> str:
        path = self.store.data_path("fresh")
        (self.spark.read.parquet(m.fresh).unionAll(keys) if m.fresh else keys).distinct().coalesce(1).write.parquet(path)
        return path

    def mark_dirty(self) -> None:
        self.store.update(lambda m: {"forced": True})

    # ---- reads

    def _read_event(self, source: str) -> None:
        self.engine.events.emit("read", lambda: {"view": self.spec.name, "source": source, "stale": self.is_stale()})

    def stored(self, m: Manifest | None = None) -> DataFrame:
        """What the store holds, past all routing."""
        m = m or self.manifest
        if not m.schema:
            return self.empty()
        return shown(self.spec, self.store.read(m))

    def resident(self, m: Manifest) -> DataFrame:
        """A small stored version as a local relation, fetched once per version: reading it
        starts no job."""
        held = self._resident
        if held is None or held[0] != m.buckets:
            rows = self.stored(m)
            held = self._resident = (m.buckets, self.spark.createDataFrame(rows.toArrow(), schema=rows.schema) if m.row_count else rows)
        return held[1]

    def empty(self) -> DataFrame:
        """A frame of the view's columns without rows."""
        return self.spark.createDataFrame([], live(self.spec, self.engine.catalog.read).schema)

    def df(self) -> DataFrame:
        """The view's rows: stored if it is built, else what its cold-read policy says. A read
        never builds the view."""
        m = self.manifest
        if m.warm:
            self._read_event("cache")
            return self.resident(m) if 0 < m.row_count <= self.engine.config.resident_rows else self.stored(m)
        how = self.spec.cold_read or self.engine.config.default_cold_read
        if how == "raise":
            raise NotMaterialized(f"view {self.spec.name!r} isn't built")
        self._read_event("cache" if how == "serve_stale" else "source")
        return self.stored(m) if how == "serve_stale" else live(self.spec, self.engine.catalog.read)

    def keyed(self, conditions: dict) -> list[tuple] | None:
        """Key tuples if the conditions are exactly the group keys; lists multiply out."""
        scope = self.spec.scope
        if not scope or set(conditions) != set(scope):
            return None
        values = [list(v) if isinstance(v, (list, tuple, set)) else [v] for v in (conditions[k] for k in scope)]
        if any(not v or any(x is None for x in v) for v in values):
            return None
        return list(itertools.product(*values))

    def where(self, *predicates: str | Column, **conditions) -> DataFrame:
        """Rows that meet the conditions. On a cold view a condition on all group keys is
        answered from the store for keys it holds, else from the source, and those keys are
        remembered to be stored by the next refresh."""
        tuples = None if predicates else self.keyed(conditions)
        m = self.manifest
        if tuples and not m.warm:
            held = self._fresh(m)
            if held and all(t in held for t in tuples) and not self.pending_batches(m):
                self._read_event("cache")
                return self.stored(m).where(key_filter(self.spec.scope, tuples))
            if len(tuples) <= self.engine.config.max_tracked_keys:
                texts = [key_text(t) for t in tuples]
                self.store.update(lambda x: {"pending": x.pending + tuple(t for t in texts if t not in x.pending)})
                self.engine.scheduler.schedule(self.spec.name, self.spec.strategy, self.debounce)
            self._read_event("source")
            return live(self.spec, self.engine.catalog.read).where(key_filter(self.spec.scope, tuples))
        out = self.df()
        for k, v in conditions.items():
            many = isinstance(v, (list, tuple, set))
            out = out.where(key_filter((k,), [(x,) for x in v]) if many and v else F.lit(False) if many else F.col(k).eqNullSafe(F.lit(v)))
        for p in predicates:
            out = out.where(p)
        return out

    @property
    def debounce(self) -> float:
        return self.spec.debounce if self.spec.debounce is not None else self.engine.config.default_debounce

    def lookup(self, **conditions) -> Row | None:
        return self._one(self.where(**conditions))

    def _order(self, descending: bool = False) -> list[Column]:
        names = self.spec.scope or tuple(self.df().columns)
        return [F.col(k).desc() if descending else F.col(k).asc() for k in names]

    def _one(self, df: DataFrame) -> Row | None:
        rows = df.limit(1).collect()
        return rows[0] if rows else None

    def first_df(self, n: int = 1) -> DataFrame:
        return self.df().orderBy(*self._order()).limit(n)

    def first(self) -> Row | None:
        """The first row by the group keys (nulls first)."""
        return self._one(self.first_df())

    def second(self) -> Row | None:
        rows = self.first_df(2).collect()
        return rows[1] if len(rows) > 1 else None

    def last(self) -> Row | None:
        return self._one(self.df().orderBy(*self._order(descending=True)))

    def take(self, n: int) -> list[Row]:
        return self.first_df(n).collect()

    def count(self) -> int:
        m = self.manifest
        if m.warm:
            self._read_event("cache")
            return m.row_count
        return self.df().count()

    def calculate(self, *aggregates: Column) -> Row:
        """Aggregates over the view's rows (sum, minimum, maximum, average ...)."""
        return self.df().agg(*aggregates).first()

    def batches(self, size: int = 1000) -> Iterator[list[Row]]:
        """Rows in batches, by the group keys; only a built view has a stable order."""
        if not self.is_warm():
            raise NotMaterialized(f"view {self.spec.name!r} must be built to be read in batches")
        rows = self.stored().orderBy(*self._order()).toLocalIterator(prefetchPartitions=True)
        while held := list(itertools.islice(rows, size)):
            yield held

    def each(self) -> Iterator[Row]:
        for held in self.batches():
            yield from held

    def warm_up(self) -> RefreshResult | None:
        """Asks for the declared keys and stores them; nothing to do on a built view."""
        wanted = self.spec.warm_keys() if callable(self.spec.warm_keys) else list(self.spec.warm_keys)
        if self.is_warm() or not wanted:
            return None
        texts = []
        for conditions in wanted:
            tuples = self.keyed(conditions)
            if tuples is None:
                raise ValueError(f"view {self.spec.name!r}: warm keys must give every group key")
            texts += [key_text(t) for t in tuples]
        self.store.update(lambda x: {"pending": x.pending + tuple(t for t in dict.fromkeys(texts) if t not in x.pending)})
        return self.refresh()

    # ---- integrity

    def schema_drift(self) -> dict[str, list[str]]:
        """How the stored columns differ from the declared ones; all empty if nothing is stored."""
        m = self.manifest
        now = live_state(self.spec, self.engine.catalog.read).schema
        return schema_drift(T.StructType.fromJson(json.loads(m.schema)), now) if m.schema else {"missing": [], "extra": [], "changed": []}

    def ddl(self) -> str:
        return create_table_ddl(f"mv_{self.spec.name}", live(self.spec, self.engine.catalog.read).schema)

    def verify(self, mode: str = "full", sample: int | float | None = None, seed: int = 0) -> verify.Verification:
        """Compares the stored view with the live result, both pinned to one moment."""
        if mode not in verify.MODES:
            raise ValueError(f"verification mode {mode!r} is none of {', '.join(verify.MODES)}")
        m, read, out = self.manifest, self.engine.catalog.pinned(), verify.Verification(self.spec.name, mode)
        if not m.warm:
            return replace(out, skipped="not built")
        if not self.spec.grouped:
            return replace(out, skipped="no keys")
        if any(self.schema_drift().values()):
            return replace(out, skipped="schema drift")
        scope, here, there = self.spec.scope, self.stored(m), live(self.spec, read)
        total = m.row_count
        n = verify.sample_size(sample, total)
        if n is not None:
            chosen = verify.sampled_keys(here, scope, n, seed)
            path = self.store.data_path("samples")
            chosen.write.parquet(path)  # both sides must see the same sample
            chosen = self.spark.read.parquet(path)
            here, there = verify.restricted(here, chosen, scope), verify.restricted(there, chosen.toDF(*scope), scope)
        drift = verify.drift(here, there, scope, mode)
        counts = {r["status"]: r["n"] for r in drift.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return replace(out, total=total, checked=total if n is None else n, drift=drift, **{s: counts.get(s, 0) for s in ("missing", "extra", "mismatched")})

    def verify_or_raise(self, mode: str = "full", **options) -> verify.Verification:
        out = self.verify(mode, **options)
        if not out.ok:
            raise DataDrift(f"{self.spec.name}: {out.missing} missing, {out.extra} extra, {out.mismatched} mismatched keys")
        return out

    def reconcile(self, mode: str = "full", sample: int | float | None = None) -> ReconcileResult:
        """Applies what is pending, compares, and recomputes the keys that differ."""
        name = self.spec.name
        if not self.is_warm():
            return ReconcileResult(name, skipped=True)
        try:
            self.refresh()
        except AlreadyRefreshing:
            return ReconcileResult(name, deferred=True)
        found = self.verify(mode, sample)
        repaired = 0
        if found.drift is not None and not found.ok:
            broken = found.missing + found.extra + found.mismatched
            try:
                self._cycle(lambda m: self._repair(m, found.drift.select(*self.spec.scope), broken))
            except AlreadyRefreshing:
                return ReconcileResult(name, deferred=True)
            repaired = broken
        now = self.engine.config.clock()
        self.store.update(lambda m: {"reconciled_at": now, "reconciled_keys": repaired})
        out = ReconcileResult(name, repaired, found.checked)
        self.engine.events.emit("reconcile", lambda: {"view": name, "repaired": repaired, "checked": found.checked})
        return out

    def _repair(self, m: Manifest, keys: DataFrame, n: int):
        """Recomputes the keys that differ together with whatever the log holds by now, so that
        data and log position stay at one moment."""
        if n > self.engine.config.max_tracked_keys:
            return self._rebuild(m)
        return self._maintain(m, [tuple(r) for r in keys.collect()])
