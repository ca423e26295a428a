"""The engine: tables, views, change intake, and operations over all views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import Events
from .operators.images import change_schema, from_descriptors
from .operators.verify import Verification
from .plans.spec import ViewSpec
from .policy import AlreadyRefreshing, Config, DataDrift, ReconcileResult, RefreshResult, Scheduler
from .sources.catalog import Catalog, Table, table_name
from .sources.changelog import ChangeLog
from .sources.debezium import holds_change, source_table, to_descriptor, to_descriptors
from .sources.diff import Outbox, key_images
from .view import View


class Engine:
    def __init__(self, spark: SparkSession, config: Config | str):
        self.spark = spark
        self.config = config if isinstance(config, Config) else Config(config)
        self.log, self.events = ChangeLog(spark, self.config.state_dir), Events()
        self.catalog = Catalog(self.log, lambda table: self._published(table, "managed"))
        self.outbox = Outbox(spark, self.config.state_dir)
        self.scheduler = Scheduler(lambda name: self._refresh_if_dirty(name))
        self.views: dict[str, View] = {}

    # ---- declarations

    def table(self, name: str, rows: DataFrame, row_id: tuple[str, ...] = (), not_null: tuple[str, ...] = (), replay: bool = True) -> Table:
        return self.catalog.register(name, rows, row_id, not_null, replay)

    def view(self, spec: ViewSpec) -> View:
        if spec.name in self.views:
            raise ValueError(f"view {spec.name!r} is declared already")
        for t in spec.depends_on:
            self.catalog.table(t)
        self.views[spec.name] = View(self, spec)
        return self.views[spec.name]

    def dependents(self, table: str, origin: str | None = None) -> list[View]:
        """Views that read the table and, if given, are fed from that origin."""
        return [v for v in self.views.values() if table_name(table) in v.spec.depends_on and origin in (None, v.spec.feed)]

    # ---- changes

    def _published(self, table: str, origin: str | None) -> None:
        for v in self.dependents(table, origin):
            self.scheduler.schedule(v.spec.name, v.spec.strategy, v.debounce)

    def _refresh_if_dirty(self, name: str) -> None:
        if self.views[name].is_dirty():
            self.views[name].refresh()

    def ingest(self, table: str, changes: list[dict] | DataFrame, token: str | None = None) -> bool:
        """Appends changes that someone else made (descriptors or change rows) for views with
        an external feed; False if the token is known already."""
        name = table_name(table)
        schema = self.catalog.table(name).schema
        rows = changes if isinstance(changes, DataFrame) else from_descriptors(self.spark, changes, schema)
        rows = rows.select(*change_schema(schema).fieldNames())
        if self.log.append(name, rows, "external", token) is None:
            return False
        self._published(name, "external")
        return True

    def ingest_change(self, table: str, operation: str, **parts) -> bool:
        return self.ingest(table, [{"operation": operation, **parts}])

    def ingest_debezium(self, envelopes: list[dict | None] | DataFrame, table: str | None = None, token: str | None = None) -> int:
        """Envelopes as maps, or a DataFrame with a ``value`` column of JSON texts; how many changes
        they held (-1: not counted). Tombstones count for nothing.

        Each envelope goes to the table it names; ``table`` overrides that for maps, and for a
        DataFrame picks the envelopes of that table and those that name none. One token covers
        the changes of each table of the call.
        """
        if isinstance(envelopes, DataFrame):
            for name in [table] if table else self._tables_of(envelopes):
                self.ingest(name, to_descriptors(envelopes, self.catalog.table(name).schema, table=name), token)
            return -1
        found: dict[str, list[dict]] = {}
        for e in envelopes:
            if (d := to_descriptor(e, table)) is not None:
                found.setdefault(table_name(d["table"]), []).append(d)
        return sum(len(rows) for name, rows in found.items() if self.ingest(name, rows, token))

    def _tables_of(self, envelopes: DataFrame) -> list[str]:
        """The tables that the envelopes name: registered ones, all others are an error."""
        named = source_table(F.col("value"))
        rows = envelopes.select(named.alias("name"), holds_change(F.col("value")).alias("change")).where("change").select("name").distinct()
        names = [r["name"] for r in rows.limit(len(self.catalog) + 2).collect()]
        if None in names:
            raise ValueError("an envelope names no table")
        return sorted({self.catalog.table(n).name for n in names})

    def mark_dirty(self, *tables: str) -> None:
        """Everything that reads the tables must be recomputed."""
        for t in tables:
            self.log.append(table_name(t), None, "managed")
            self._published(t, None)

    def capture_diff(self, table: str, new: DataFrame, columns: tuple[str, ...] = ()) -> None:
        """Queues the differences between the table as registered and ``new``, which becomes
        its content: capture for tables that nothing else reports on."""
        t = self.catalog.table(table)
        self.outbox.capture(t.name, key_images(t.rows(), new, t.row_id, tuple(columns) or t.row_id))
        t.replace(new)

    def drain_outbox(self, limit: int | None = None) -> int:
        return self.outbox.drain(lambda table, rows: self.ingest(table, rows), lambda table: self.catalog.table(table).schema, limit)

    # ---- operations over all views

    def _each(self, views: list[View], work) -> list:
        """Runs ``work`` on the views, several at a time, in the engine's scheduler pool."""

        def one(v: View):
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.config.pool)
            return work(v)

        with ThreadPoolExecutor(max(1, self.config.parallel)) as pool:
            return list(pool.map(one, views))

    def stale_views(self) -> list[View]:
        return [v for v in self.views.values() if v.is_stale()]

    def refresh_all(self) -> list[RefreshResult]:
        return self._each(list(self.views.values()), View.refresh)

    def refresh_stale(self) -> list[RefreshResult]:
        return self._each([v for v in self.stale_views() if v.is_materialized()], View.refresh)

    def rebuild_all(self, confirm: bool = False) -> list[RefreshResult]:
        return self._each(list(self.views.values()), lambda v: v.rebuild(confirm))

    def warm_up_all(self) -> list[RefreshResult | None]:
        return self._each(list(self.views.values()), View.warm_up)

    def enqueue_refreshes(self) -> list[str]:
        """Schedules the built views that are stale; their names."""
        names = [v.spec.name for v in self.stale_views() if v.is_materialized()]
        for n in names:
            self.scheduler.schedule(n, "async", self.views[n].debounce)
        return names

    def verify_all(self, mode: str = "full", **options) -> list[Verification]:
        return self._each(list(self.views.values()), lambda v: v.verify(mode, **options))

    def verify_all_or_raise(self, mode: str = "full", **options) -> list[Verification]:
        out = self.verify_all(mode, **options)
        if bad := [r for r in out if not r.ok]:
            raise DataDrift("; ".join(f"{r.view}: {r.missing} missing, {r.extra} extra, {r.mismatched} mismatched" for r in bad))
        return out

    def reconcile_all(self, only_stale: bool = False, **options) -> list[ReconcileResult]:
        """A view that fails reports its error and doesn't stop the others."""

        def one(v: View) -> ReconcileResult:
            try:
                return v.reconcile(**options)
            except AlreadyRefreshing:
                return ReconcileResult(v.spec.name, deferred=True)
            except Exception as e:
                return ReconcileResult(v.spec.name, error=f"{type(e).__name__}: {e}"[:500])

        return self._each(self.stale_views() if only_stale else list(self.views.values()), one)

    def enqueue_reconciles(self) -> list[str]:
        """Reconciles the built views that are stale, each checked again before it starts."""
        names = [v.spec.name for v in self.stale_views() if v.is_materialized()]
        self._each([self.views[n] for n in names], lambda v: v.reconcile() if v.is_stale() else None)
        return names

    def schema_drift(self) -> dict[str, dict[str, list[str]]]:
        return {n: d for n, v in self.views.items() if any((d := v.schema_drift()).values())}

    def status(self) -> DataFrame:
        """One row of metadata per view."""
        rows = [
            (n, m.warm, v.is_dirty(), v.is_refreshing(), m.row_count, m.version, m.applied_seq, m.epoch, m.refreshed_at, m.duration_ms, m.reconciled_at, m.reconciled_keys, m.last_error)
            for n, v in self.views.items()
            for m in [v.manifest]
        ]
        return self.spark.createDataFrame(rows, "view string, warm boolean, dirty boolean, refreshing boolean, row_count long, version int, applied_seq long, epoch int, refreshed_at double, duration_ms double, reconciled_at double, reconciled_keys int, last_error string")
