"""The engine's registered queries: each does real maintenance and returns the stored view.

``ORACLE_SQL`` holds, for each, the plain query over the final state of the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import avg_of, count_all, count_distinct, count_of, max_of, min_of, sum_length, sum_of
from .operators.images import change_schema
from .plans import Join, Relation, ViewSpec
from .policy import Config
from .sources.diff import key_images
from .streaming import stream_changes, stream_inserts

#: Used only where the session names no shared folder.
LOCAL_SHARED = "file:///tmp/checkpoints"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PRICE = {"price": "cast(o_totalprice as decimal(18,2))"}
SQL_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
MOVED = "case when o_orderstatus = 'O' then 'F' when o_orderstatus = 'F' then 'P' else 'O' end"
#: orders after inserting the held-back tenth, deleting a seventh and moving a fifth.
FINAL = f"(SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN {MOVED} ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 7 <> 0)"


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def state_dir(spark: SparkSession) -> str:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SHARED).rstrip("/")
    return f"{shared}/views-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:10]}"


def engine(spark: SparkSession, sf_dir: str, *tables: str, **rows: DataFrame) -> Engine:
    """An engine with the named tables as they are, and others with the given rows."""
    e = Engine(spark, Config(state_dir(spark), default_strategy="manual"))
    ids = {"orders": ("o_orderkey",), "customer": ("c_custkey",), "events": ("event_id",), "part": ("p_partkey",)}
    for t in tables:
        e.table(t, load(spark, sf_dir, t), ids.get(t, ()))
    for t, df in rows.items():
        e.table(t, df, ids.get(t, ()))
    return e


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(name: str, relation: Relation, keys=(), aggs=(), **more) -> ViewSpec:
    return ViewSpec(name, relation, tuple(keys), tuple(aggs), strategy="manual", buckets=2, **more)


def built(spark: SparkSession, sf_dir: str, view: ViewSpec) -> DataFrame:
    """Builds the view over the tables as they are and reads it from the store."""
    v = engine(spark, sf_dir, *view.depends_on).view(view)
    v.rebuild(confirm=True)
    return v.df()


# ---- aggregates

BY_STATUS = ("o_orderstatus",)


@query(f"SELECT o_orderstatus, SUM({SQL_PRICE}) AS revenue FROM orders GROUP BY o_orderstatus")
def agg_sum(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_sum", Relation("orders", columns=PRICE), BY_STATUS, [sum_of("price", "revenue")]))


@query(f"SELECT o_orderstatus, CAST(SUM({SQL_PRICE}) AS DOUBLE) / COUNT(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus")
def agg_avg(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_avg", Relation("orders", columns=PRICE), BY_STATUS, [avg_of("price", "mean")]))


@query(f"SELECT o_orderstatus, MIN({SQL_PRICE}) AS least, MAX({SQL_PRICE}) AS most FROM orders GROUP BY o_orderstatus")
def agg_min_max(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_min_max", Relation("orders", columns=PRICE), BY_STATUS, [min_of("price", "least"), max_of("price", "most")]))


@query("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
def agg_count_star(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_count_star", Relation("orders"), ["o_orderpriority"], [count_all("n")]))


@query("SELECT o_orderstatus, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS n FROM orders GROUP BY o_orderstatus")
def agg_count_col(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_count_col", Relation("orders"), BY_STATUS, [count_of("nullif(o_orderpriority, '1-URGENT')", "n")]))


@query("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_count_distinct", Relation("orders"), BY_STATUS, [count_distinct("o_custkey", "customers")]))


@query("SELECT p_brand, CAST(SUM(LENGTH(p_name)) AS BIGINT) AS name_chars FROM part GROUP BY p_brand")
def agg_sum_length(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_sum_length", Relation("part"), ["p_brand"], [sum_length("p_name", "name_chars")]))


@query("SELECT COUNT(*) AS n, MIN(l_quantity) AS least, MAX(l_shipdate) AS last_ship FROM lineitem")
def agg_global(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_global", Relation("lineitem"), (), [count_all("n"), min_of("l_quantity", "least"), max_of("l_shipdate", "last_ship")]))


@query(
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS quantity,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_extendedprice) AS mean_price, MIN(l_discount) AS least, MAX(l_discount) AS most,
    COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_multi_key(spark, sf_dir):
    dec = {"qty": "cast(l_quantity as decimal(18,2))", "price": "cast(l_extendedprice as decimal(18,2))"}
    aggs = [count_all("n"), sum_of("qty", "quantity"), avg_of("price", "mean_price"), min_of("l_discount", "least"), max_of("l_discount", "most"), count_distinct("l_suppkey", "suppliers")]
    return built(spark, sf_dir, spec("agg_multi_key", Relation("lineitem", columns=dec), ["l_returnflag", "l_linestatus"], aggs))


@query(f"SELECT NULLIF(o_orderstatus, 'F') AS status, COUNT(*) AS n, SUM({SQL_PRICE}) AS revenue FROM orders GROUP BY 1")
def agg_null_group(spark, sf_dir):
    return built(spark, sf_dir, spec("agg_null_group", Relation("orders", columns=PRICE | {"status": "nullif(o_orderstatus, 'F')"}), ["status"], [count_all("n"), sum_of("price", "revenue")]))


# ---- relational shapes


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_lookup(spark, sf_dir):
    return built(spark, sf_dir, spec("distinct_lookup", Relation("orders"), ["o_orderstatus", "o_orderpriority"], distinct=True))


@query(f"SELECT o_custkey, COUNT(*) AS n, SUM({SQL_PRICE}) AS revenue FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def having_filter(spark, sf_dir):
    return built(spark, sf_dir, spec("having_filter", Relation("orders", columns=PRICE), ["o_custkey"], [count_all("n"), sum_of("price", "revenue")], having="n > 12"))


@query("SELECT p_size, COUNT(*) AS n FROM part WHERE (p_name ILIKE '%A%' OR p_brand IN ('Brand#11', 'Brand#12')) AND p_type NOT ILIKE '%zzz%' AND p_size > 5 AND p_size < 40 GROUP BY p_size")
def pred_ilike_or_in(spark, sf_dir):
    where = "(p_name ilike '%A%' or p_brand in ('Brand#11', 'Brand#12')) and p_type not ilike '%zzz%' and p_size > 5 and p_size < 40"
    return built(spark, sf_dir, spec("pred_ilike_or_in", Relation("part", where=where), ["p_size"], [count_all("n")]))


TO_NATION = (Join("customer", "o_custkey = c_custkey"), Join("nation", "c_nationkey = n_nationkey"))
NATION_SQL = f"SELECT n_name, COUNT(*) AS n, SUM({SQL_PRICE}) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query(NATION_SQL)
def join_two_hop_group(spark, sf_dir):
    return built(spark, sf_dir, spec("join_two_hop_group", Relation("orders", TO_NATION, columns=PRICE), ["n_name"], [count_all("n"), sum_of("price", "revenue")]))


@query(
    """SELECT n_name, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) > 1993 GROUP BY n_name"""
)
def join_fanout_distinct(spark, sf_dir):
    rel = Relation("lineitem", (Join("orders", "l_orderkey = o_orderkey"), *TO_NATION), where="year(o_orderdate) > 1993")
    return built(spark, sf_dir, spec("join_fanout_distinct", rel, ["n_name"], [count_all("n"), count_distinct("l_partkey", "parts"), count_distinct("o_orderkey", "orders")]))


@query(
    """SELECT year(o_orderdate) AS y, COUNT(*) AS pairs, COUNT(DISTINCT a.l_orderkey) AS orders FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    JOIN orders ON a.l_orderkey = o_orderkey GROUP BY 1 HAVING COUNT(*) > 1000"""
)
def self_join_theta(spark, sf_dir):
    joins = (Join("lineitem", "l_orderkey = b_l_orderkey and l_partkey < b_l_partkey", alias="b"), Join("orders", "l_orderkey = o_orderkey"))
    rel = Relation("lineitem", joins, columns={"y": "cast(year(o_orderdate) as bigint)"})
    return built(spark, sf_dir, spec("self_join_theta", rel, ["y"], [count_all("pairs"), count_distinct("l_orderkey", "orders")], having="pairs > 1000"))


@query(
    """SELECT s_nationkey, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_orderkey) AS orders, CAST(SUM(LENGTH(p_name)) AS BIGINT) AS name_chars FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE p_name ILIKE '%E%' GROUP BY s_nationkey"""
)
def cross_parts_by_supplier(spark, sf_dir):
    rel = Relation("lineitem", (Join("part", "l_partkey = p_partkey"), Join("supplier", "l_suppkey = s_suppkey")), where="p_name ilike '%E%'")
    return built(spark, sf_dir, spec("cross_parts", rel, ["s_nationkey"], [count_distinct("l_partkey", "parts"), count_distinct("l_orderkey", "orders"), sum_length("p_name", "name_chars")]))


@query(
    """SELECT c_mktsegment, year(o_orderdate) AS y, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' GROUP BY 1, 2 HAVING COUNT(*) > 50"""
)
def network_by_segment_year(spark, sf_dir):
    rel = Relation(
        "lineitem", (Join("orders", "l_orderkey = o_orderkey"), TO_NATION[0]), where="o_orderpriority ilike '%urgent%' or o_orderpriority ilike '%high%'", columns={"y": "cast(year(o_orderdate) as bigint)"}
    )
    return built(spark, sf_dir, spec("network", rel, ["c_mktsegment", "y"], [count_all("n"), count_distinct("o_custkey", "customers"), count_distinct("l_partkey", "parts")], having="n > 50"))


@query(
    """SELECT MIN(p_name) AS part, MIN(s_name) AS supplier, MIN(p_size) AS size FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_returnflag = 'R' AND NOT p_name ILIKE '%zz%' AND (p_type ILIKE '%s%' OR p_type ILIKE '%p%')"""
)
def global_min_parts(spark, sf_dir):
    rel = Relation("lineitem", (Join("part", "l_partkey = p_partkey"), Join("supplier", "l_suppkey = s_suppkey")), where="l_returnflag = 'R' and not p_name ilike '%zz%' and (p_type ilike '%s%' or p_type ilike '%p%')")
    return built(spark, sf_dir, spec("global_min", rel, (), [min_of("p_name", "part"), min_of("s_name", "supplier"), min_of("p_size", "size")]))


CHAIN = (
    Join("orders", "l_orderkey = o_orderkey"),
    *TO_NATION,
    Join("region", "n_regionkey = r_regionkey"),
    Join("part", "l_partkey = p_partkey"),
    Join("supplier", "l_suppkey = s_suppkey"),
    Join("nation", "s_nationkey = sn_n_nationkey", alias="sn"),
)


@query(
    """SELECT MIN(c_name) AS customer, MIN(s_name) AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey
    JOIN region ON n.n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AND r_regionkey = 1 AND l_returnflag = 'A' AND year(o_orderdate) > 1993"""
)
def chain_min(spark, sf_dir):
    rel = Relation("lineitem", CHAIN, where="o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') and r_regionkey = 1 and l_returnflag = 'A' and year(o_orderdate) > 1993")
    return built(spark, sf_dir, spec("chain_min", rel, (), [min_of("c_name", "customer"), min_of("s_name", "supplier")]))


@query(
    """SELECT MIN(c_name) AS customer, MIN(p_name) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    WHERE p_type ILIKE '%e%' AND p_type ILIKE '%s%' AND l_linestatus = 'O' AND c_nationkey = 7"""
)
def double_ilike_min(spark, sf_dir):
    rel = Relation("lineitem", (Join("orders", "l_orderkey = o_orderkey"), TO_NATION[0], Join("part", "l_partkey = p_partkey")), where="p_type ilike '%e%' and p_type ilike '%s%' and l_linestatus = 'O' and c_nationkey = 7")
    return built(spark, sf_dir, spec("double_ilike", rel, (), [min_of("c_name", "customer"), min_of("p_name", "part")]))


@query("SELECT o_orderstatus, MAX(n) AS most FROM (SELECT o_orderstatus, o_custkey, COUNT(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_orderstatus")
def opaque_query(spark, sf_dir):
    """A view of any DataFrame, recomputed by a key that it declares."""
    per_customer = lambda read: read("orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("o_orderstatus").agg(F.max("n").alias("most"))
    e = engine(spark, sf_dir, orders=load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"))
    v = e.view(ViewSpec("opaque", query=per_customer, depends_on=("orders",), maintenance_keys=("o_orderstatus",), strategy="manual"))
    v.rebuild(confirm=True)
    e.catalog.table("orders").insert(load(spark, sf_dir, "orders").where("o_orderkey % 10 = 0"))
    v.refresh()
    return v.df()


# ---- maintained views: built on nine tenths of orders, then changed


def maintained(spark, sf_dir, view: ViewSpec, *steps: str, expect: str, base: str = "o_orderkey % 10 <> 0", cap: int | None = None) -> DataFrame:
    """Builds the view, makes the named writes, refreshes, and reads it from the store. Where the
    writes insert, the rows outside ``base`` are those that come; else all orders are there."""
    orders = load(spark, sf_dir, "orders")
    base = base if "insert" in steps else "true"
    e = engine(spark, sf_dir, *(t for t in view.depends_on if t != "orders"), orders=orders.where(base))
    if cap:
        e.config.max_tracked_keys = cap
    v = e.view(view)
    v.rebuild(confirm=True)
    t = e.catalog.table("orders")
    for step in steps:
        if step == "insert":
            t.insert(orders.where(f"not ({base})"))
        elif step.startswith("delete "):
            t.delete(step[7:])
        elif step == "move":
            t.update("o_orderkey % 5 = 0", {"o_orderstatus": MOVED})
        elif step == "reprice":
            t.update("o_orderkey % 5 = 0", {"o_totalprice": "o_totalprice + 1"})
        elif step == "segment":
            e.catalog.table("customer").update("c_custkey % 4 = 0", {"c_mktsegment": "'MOVED'"})
    if (got := v.refresh().path) != expect:
        raise RuntimeError(f"{view.name}: maintained by {got}, not by {expect}")
    return v.df()


SEVENTH = "delete o_orderkey % 7 = 0"
LESS = "(SELECT * FROM orders WHERE o_orderkey % 7 <> 0)"
EXTREMES = [min_of("price", "least"), max_of("price", "most"), count_all("n")]
SQL_EXTREMES = f"MIN({SQL_PRICE}) AS least, MAX({SQL_PRICE}) AS most, COUNT(*) AS n"


def extremes(name: str, **more) -> ViewSpec:
    return spec(name, Relation("orders", columns=PRICE), BY_STATUS, EXTREMES, **more)


@query(f"SELECT o_orderstatus, {SQL_EXTREMES} FROM orders GROUP BY o_orderstatus")
def scoped_insert(spark, sf_dir):
    return maintained(spark, sf_dir, extremes("scoped_insert"), "insert", expect="scoped")


@query("SELECT o_orderpriority, MAX(o_orderkey) AS last FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY o_orderpriority")
def scoped_delete_empties_group(spark, sf_dir):
    view = spec("scoped_empty", Relation("orders"), ["o_orderpriority"], [max_of("o_orderkey", "last")])
    return maintained(spark, sf_dir, view, "delete o_orderpriority = '3-MEDIUM'", expect="scoped")


@query(f"SELECT o_orderstatus, {SQL_EXTREMES} FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN {MOVED} ELSE o_orderstatus END AS o_orderstatus) FROM orders) GROUP BY o_orderstatus")
def scoped_update_moves_group(spark, sf_dir):
    return maintained(spark, sf_dir, extremes("scoped_move"), "move", expect="scoped")


@query(f"SELECT o_custkey, MIN({SQL_PRICE}) AS least, MAX({SQL_PRICE}) AS most FROM (SELECT * FROM orders WHERE o_orderkey % 701 <> 0) GROUP BY o_custkey")
def scoped_minmax(spark, sf_dir):
    view = spec("scoped_minmax", Relation("orders", columns=PRICE), ["o_custkey"], [min_of("price", "least"), max_of("price", "most")])
    return maintained(spark, sf_dir, view, "delete o_orderkey % 701 = 0", expect="scoped", cap=100_000)


@query(f"SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM {LESS} GROUP BY o_orderpriority")
def scoped_distinct_count(spark, sf_dir):
    view = spec("scoped_distinct", Relation("orders"), ["o_orderpriority"], [count_distinct("o_custkey", "customers")])
    return maintained(spark, sf_dir, view, SEVENTH, expect="scoped")


@query("SELECT o_custkey, COUNT(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 701 <> 0) GROUP BY o_custkey HAVING COUNT(*) > 8")
def scoped_having(spark, sf_dir):
    view = spec("scoped_having", Relation("orders"), ["o_custkey"], [count_all("n")], having="n > 8")
    return maintained(spark, sf_dir, view, "delete o_orderkey % 701 = 0", expect="scoped", cap=100_000)


BY_SEGMENT = Relation("orders", (TO_NATION[0],), columns=PRICE)
SQL_SEGMENT = f"COUNT(*) AS n, SUM({SQL_PRICE}) AS revenue"


def segment_keys(changes: DataFrame, read) -> DataFrame:
    """Segments of the customers whose orders changed."""
    customers = changes.select(F.explode(F.array("before.o_custkey", "after.o_custkey")).alias("o_custkey")).where("o_custkey is not null").distinct()
    return customers.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment").distinct()


@query(f"SELECT c_mktsegment, {SQL_SEGMENT} FROM {LESS} JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def scoped_joined_key_resolver(spark, sf_dir):
    view = spec("scoped_resolver", BY_SEGMENT, ["c_mktsegment"], [count_all("n"), sum_of("price", "revenue")], resolvers={"orders": segment_keys})
    return maintained(spark, sf_dir, view, SEVENTH, expect="scoped")


@query(f"SELECT c_mktsegment, {SQL_SEGMENT} FROM {LESS} JOIN (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment) FROM customer) ON o_custkey = c_custkey GROUP BY c_mktsegment")
def scoped_dimension_move(spark, sf_dir):
    """Orders and their customers change in the same range; keys are derived by joining."""
    view = spec("scoped_dimension", BY_SEGMENT, ["c_mktsegment"], [count_all("n"), sum_of("price", "revenue")])
    return maintained(spark, sf_dir, view, SEVENTH, "segment", expect="scoped")


@query(f"SELECT NULLIF(o_orderstatus, 'F') AS status, {SQL_EXTREMES} FROM {LESS} GROUP BY 1")
def scoped_null_key(spark, sf_dir):
    view = spec("scoped_null", Relation("orders", columns=PRICE | {"status": "nullif(o_orderstatus, 'F')"}), ["status"], EXTREMES)
    return maintained(spark, sf_dir, view, SEVENTH, expect="scoped")


def external(spark, sf_dir, view: ViewSpec, final: str, changes: Callable[[Engine, DataFrame, DataFrame], None], expect: str) -> DataFrame:
    """Builds the view on all orders; then someone else changes the table and reports it."""
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders)
    v = e.view(view)
    v.rebuild(confirm=True)
    new = orders.where(final)
    e.catalog.table("orders").replace(new)
    changes(e, orders, new)
    if (got := v.refresh().path) != expect:
        raise RuntimeError(f"{view.name}: maintained by {got}, not by {expect}")
    return v.df()


def by_priority(name: str) -> ViewSpec:
    return spec(name, Relation("orders"), ["o_orderpriority"], [count_all("n")], feed="external")


SQL_PRIORITY = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderpriority"


@query(SQL_PRIORITY)
def widen_partial_image(spark, sf_dir):
    """An update without its old row: the key it left is unknown, so everything is recomputed."""
    update = {"operation": "update", "after": {"o_orderkey": 1, "o_orderpriority": "1-URGENT"}}
    return external(spark, sf_dir, by_priority("widen_partial"), "o_orderkey % 7 <> 0", lambda e, old, new: e.ingest("orders", [update]), "widen")


@query(f"SELECT o_custkey, MAX({SQL_PRICE}) AS most FROM {LESS} GROUP BY o_custkey")
def widen_cap(spark, sf_dir):
    view = spec("widen_cap", Relation("orders", columns=PRICE), ["o_custkey"], [max_of("price", "most")])
    return maintained(spark, sf_dir, view, SEVENTH, expect="widen", cap=5)


# ---- signed deltas

TOTALS = [count_all("n"), sum_of("price", "revenue"), avg_of("price", "mean"), count_of("nullif(o_orderpriority, '1-URGENT')", "calm")]
SQL_TOTALS = f"COUNT(*) AS n, SUM({SQL_PRICE}) AS revenue, CAST(SUM({SQL_PRICE}) AS DOUBLE) / COUNT(o_totalprice) AS mean, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS calm"


def totals(name: str, key: str = "o_orderstatus", **relation) -> ViewSpec:
    return spec(name, Relation("orders", columns=PRICE, **relation), [key], TOTALS)


@query(f"SELECT o_orderstatus, {SQL_TOTALS} FROM orders GROUP BY o_orderstatus")
def delta_insert(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_insert"), "insert", expect="delta")


@query(f"SELECT o_orderstatus, {SQL_TOTALS} FROM {LESS} GROUP BY o_orderstatus")
def delta_delete(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_delete"), SEVENTH, expect="delta")


@query(
    f"""SELECT o_orderstatus, COUNT(*) AS n, SUM({SQL_PRICE} + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS revenue,
    CAST(SUM({SQL_PRICE} + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(o_totalprice) AS mean, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS calm FROM orders GROUP BY o_orderstatus"""
)
def delta_update_inplace(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_reprice"), "reprice", expect="delta")


@query(f"SELECT o_orderstatus, {SQL_TOTALS} FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN {MOVED} ELSE o_orderstatus END AS o_orderstatus) FROM orders) GROUP BY o_orderstatus")
def delta_move(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_move"), "move", expect="delta")


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders GROUP BY o_orderpriority")
def delta_new_group(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_new", "o_orderpriority"), "insert", expect="delta", base="o_orderpriority <> '4-NOT SPECIFIED'")


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority")
def delta_emptied_group(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_emptied", "o_orderpriority"), "delete o_orderpriority = '5-LOW'", expect="delta")


@query(f"SELECT o_orderstatus, {SQL_TOTALS} FROM {FINAL} WHERE o_orderpriority ILIKE '%low%' GROUP BY o_orderstatus")
def delta_filtered_view(spark, sf_dir):
    """The view's predicate is evaluated on the changed rows, old and new."""
    return maintained(spark, sf_dir, totals("delta_filtered", where="o_orderpriority ilike '%low%'"), "insert", SEVENTH, "move", expect="delta")


@query(f"SELECT o_orderstatus, {SQL_TOTALS} FROM {FINAL} GROUP BY o_orderstatus")
def delta_random_mix(spark, sf_dir):
    return maintained(spark, sf_dir, totals("delta_mix"), "insert", SEVENTH, "move", expect="delta")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def delta_distinct(spark, sf_dir):
    view = spec("delta_distinct", Relation("orders"), ["o_orderpriority"], distinct=True)
    return maintained(spark, sf_dir, view, "delete o_orderpriority = '5-LOW'", expect="delta")


# ---- reads


@query(NATION_SQL)
def cold_read_through(spark, sf_dir):
    """A view that was never built answers from its tables."""
    view = spec("cold", Relation("orders", TO_NATION, columns=PRICE), ["n_name"], [count_all("n"), sum_of("price", "revenue")])
    return engine(spark, sf_dir, *view.depends_on).view(view).df()


def populated(spark, sf_dir, name: str, base: str = "o_orderkey % 10 <> 0", **more):
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders.where(base))
    return e, e.view(extremes(name, **more)), orders


@query(f"SELECT o_orderstatus, {SQL_EXTREMES} FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def cold_populated_partition(spark, sf_dir):
    """Keys read once are stored by the next refresh, and kept up with later writes."""
    e, v, orders = populated(spark, sf_dir, "cold_populated")
    v.where(o_orderstatus=["F", "O"])
    v.refresh()
    e.catalog.table("orders").insert(orders.where("o_orderkey % 10 = 0"))
    v.refresh()
    return v.where(o_orderstatus=["F", "O"])


@query(f"SELECT o_orderstatus, {SQL_EXTREMES} FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus")
def warm_up_partition(spark, sf_dir):
    _, v, _ = populated(spark, sf_dir, "warm_up", "true", warm_keys=({"o_orderstatus": "P"},))
    v.warm_up()
    return v.stored()


@query(f"SELECT o_orderpriority, {SQL_EXTREMES} FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 2")
def ordinal_first(spark, sf_dir):
    """The first rows by the implicit order, which is that of the group keys."""
    view = spec("ordinal", Relation("orders", columns=PRICE), ["o_orderpriority"], EXTREMES)
    v = engine(spark, sf_dir, "orders").view(view)
    v.rebuild(confirm=True)
    return v.first_df(2)


# ---- external changes


def deleted_rows(old: DataFrame) -> DataFrame:
    return old.where("o_orderkey % 7 = 0")


@query(SQL_PRIORITY)
def cdc_debezium_batch(spark, sf_dir):
    def report(e: Engine, old: DataFrame, new: DataFrame) -> None:
        row = F.struct("o_orderkey", "o_orderpriority")
        source = F.struct(F.lit("orders").alias("table"), F.lit(1_710_000_000_000).alias("ts_ms"))
        body = F.struct(F.lit("d").alias("op"), row.alias("before"), source.alias("source"))
        e.ingest_debezium(deleted_rows(old).select(F.to_json(F.struct(body.alias("payload"))).alias("value")), "orders")

    return external(spark, sf_dir, by_priority("cdc_debezium"), "o_orderkey % 7 <> 0", report, "scoped")


@query(SQL_PRIORITY)
def cdc_duplicates_out_of_order(spark, sf_dir):
    """The same changes twice and in reverse: recomputed groups don't mind."""

    def report(e: Engine, old: DataFrame, new: DataFrame) -> None:
        rows = key_images(old, new, ("o_orderkey",), ("o_orderpriority",))
        for part in ("before.o_orderkey % 2 = 1", "before.o_orderkey % 2 = 0", "true"):
            e.ingest("orders", rows.where(part))

    return external(spark, sf_dir, by_priority("cdc_twice"), "o_orderkey % 7 <> 0", report, "scoped")


@query(
    """SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE (o_orderpriority <> '1-URGENT' OR o_orderkey % 7 <> 0) AND (o_orderpriority <> '2-HIGH' OR (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0))
    GROUP BY o_orderpriority"""
)
def cdc_watermark_suppression(spark, sf_dir):
    """A change older than what its key has seen is passed over; other keys go on."""
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders)
    v = e.view(by_priority("cdc_watermark"))
    v.rebuild(confirm=True)
    t = e.catalog.table("orders")
    for final, key, ts in (("o_orderkey % 7 <> 0", "1-URGENT", 200), ("o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0", "1-URGENT", 100), ("o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0", "2-HIGH", 50)):
        t.replace(orders.where(final))
        e.ingest_change("orders", "destroy", key_attributes={"o_orderpriority": key}, source_ts=ts)
        v.refresh()
    return v.df()


@query("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderpriority <> '5-LOW' GROUP BY o_orderpriority")
def cdc_key_attributes(spark, sf_dir):
    """Key attributes alone scope a change: only the named group is computed anew."""
    change = {"operation": "update", "key_attributes": {"o_orderpriority": "5-LOW"}}
    return external(spark, sf_dir, by_priority("cdc_keys"), "o_orderkey % 7 <> 0", lambda e, old, new: e.ingest("orders", [change]), "scoped")


@query(SQL_PRIORITY)
def outbox_snapshot_diff(spark, sf_dir):
    """Nothing reports the change: two snapshots are compared, queued and relayed."""
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders)
    v = e.view(by_priority("outbox"))
    v.rebuild(confirm=True)
    e.capture_diff("orders", orders.where("o_orderkey % 7 <> 0"), ("o_orderpriority",))
    e.drain_outbox()
    v.refresh()
    return v.df()


# ---- verification

DRIFTED = "o_orderpriority <> '1-URGENT' AND NOT (o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0)"
SQL_DRIFT = f"""SELECT COALESCE(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'extra' ELSE 'mismatched' END AS status
    FROM (SELECT o_orderpriority, COUNT(*) AS n, SUM({SQL_PRICE}) AS s FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) a
    FULL OUTER JOIN (SELECT o_orderpriority, COUNT(*) AS n, SUM({SQL_PRICE}) AS s FROM orders WHERE {DRIFTED} GROUP BY 1) b ON a.o_orderpriority = b.o_orderpriority
    WHERE a.n IS NULL OR b.n IS NULL{{}}"""


def drifted(spark, sf_dir, name: str):
    """A built view whose table then changed without anyone saying so."""
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders.where("o_orderpriority <> '5-LOW'"))
    v = e.view(totals(name, "o_orderpriority"))
    v.rebuild(confirm=True)
    e.catalog.table("orders").replace(orders.where(DRIFTED))
    return v


@query(SQL_DRIFT.format(" OR a.n <> b.n OR a.s <> b.s"))
def verify_full(spark, sf_dir):
    return drifted(spark, sf_dir, "verify_full").verify("full").drift


@query(SQL_DRIFT.format(" OR a.n <> b.n OR a.s <> b.s"))
def verify_checksum(spark, sf_dir):
    return drifted(spark, sf_dir, "verify_checksum").verify("checksum").drift


@query(SQL_DRIFT.format(""))
def verify_row_count(spark, sf_dir):
    """Counts stored rows per key: finds keys that came or went, not other values."""
    return drifted(spark, sf_dir, "verify_row_count").verify("row_count").drift


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders WHERE {DRIFTED} GROUP BY o_orderpriority")
def reconcile_repairs(spark, sf_dir):
    v = drifted(spark, sf_dir, "reconcile")
    v.reconcile()
    return v.df()


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority")
def reconcile_counts_writes_once(spark, sf_dir):
    """A write lands between verification and repair; the next refresh must not add it again."""
    orders = load(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'")
    e = engine(spark, sf_dir, orders=orders.where("o_orderkey % 10 <> 0"))
    v, t = e.view(totals("reconcile_once", "o_orderpriority")), e.catalog.table("orders")
    v.rebuild(confirm=True)
    m = v.manifest
    wrong = v.store.read(m).withColumn("n", F.col("n") + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0))
    v.store.commit(m, **v.store.write(m, wrong))
    verify = v.verify

    def verify_then_insert(*args, **options):
        found = verify(*args, **options)
        t.insert(orders.where("o_orderkey % 10 = 0"))
        return found

    v.verify = verify_then_insert
    v.reconcile()
    v.refresh()
    return v.df()


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderpriority")
def restart_replays_writes(spark, sf_dir):
    """Managed writes outlive their engine: the next one replays them on the rows it is given."""
    orders = load(spark, sf_dir, "orders")
    first = engine(spark, sf_dir, orders=orders.where("o_orderkey % 10 <> 0"))
    first.view(totals("restart", "o_orderpriority")).rebuild(confirm=True)
    first.catalog.table("orders").insert(orders.where("o_orderkey % 10 = 0"))
    first.catalog.table("orders").delete("o_orderkey % 7 = 0")
    again = Engine(spark, first.config)
    again.table("orders", orders.where("o_orderkey % 10 <> 0"), ("o_orderkey",))
    v = again.view(totals("restart", "o_orderpriority"))
    v.rebuild(confirm=True)
    return v.df()


# ---- further shapes of maintenance


@query(f"SELECT o_orderstatus, o_orderpriority, {SQL_EXTREMES} FROM {LESS} GROUP BY o_orderstatus, o_orderpriority")
def scoped_composite_key(spark, sf_dir):
    view = spec("scoped_composite", Relation("orders", columns=PRICE), ["o_orderstatus", "o_orderpriority"], EXTREMES)
    return maintained(spark, sf_dir, view, SEVENTH, expect="scoped")


@query(f"SELECT o_orderstatus, o_orderpriority, {SQL_EXTREMES} FROM {LESS} GROUP BY o_orderstatus, o_orderpriority")
def scoped_coarser_keys(spark, sf_dir):
    """Maintenance goes by one of the two group keys."""
    view = spec("scoped_coarser", Relation("orders", columns=PRICE), ["o_orderstatus", "o_orderpriority"], EXTREMES, maintenance_keys=("o_orderstatus",))
    return maintained(spark, sf_dir, view, SEVENTH, expect="scoped")


@query(
    f"""SELECT c_mktsegment, COUNT(*) AS n, COUNT(o_orderkey) AS orders, MAX(o_orderkey) AS last FROM customer LEFT JOIN {LESS} ON o_custkey = c_custkey GROUP BY c_mktsegment"""
)
def outer_join_kept(spark, sf_dir):
    """Customers without orders stay in an outer join, and deletes of orders leave them."""
    view = spec("outer_join", Relation("customer", (Join("orders", "o_custkey = c_custkey", how="left"),)), ["c_mktsegment"], [count_all("n"), count_of("o_orderkey", "orders"), max_of("o_orderkey", "last")])
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, "customer", orders=orders)
    v = e.view(view)
    v.rebuild(confirm=True)
    e.catalog.table("orders").delete("o_orderkey % 7 = 0")
    v.refresh()
    return v.df()


@query(f"SELECT o_orderpriority, {SQL_TOTALS} FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderpriority")
def coarse_dirty_widens(spark, sf_dir):
    """A table that changed without images: a mark makes the next refresh recompute the view."""
    orders = load(spark, sf_dir, "orders")
    e = engine(spark, sf_dir, orders=orders)
    v = e.view(totals("coarse_dirty", "o_orderpriority"))
    v.rebuild(confirm=True)
    e.catalog.table("orders").replace(orders.where("o_orderkey % 7 <> 0"))
    e.mark_dirty("orders")
    if (got := v.refresh().path) != "widen":
        raise RuntimeError(f"maintained by {got}")
    return v.df()


# ---- streams

BY_TYPE = Relation("events", columns={"amount": "cast(value as decimal(18,2))"})
SQL_EVENTS = "SELECT event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18,2))) AS amount, COUNT(user_id) AS users FROM events GROUP BY event_type"


def event_totals(name: str) -> ViewSpec:
    return spec(name, BY_TYPE, ["event_type"], [count_all("n"), sum_of("amount", "amount"), count_of("user_id", "users")])


@query(SQL_EVENTS)
def stream_events_by_type(spark, sf_dir):
    """All events arrive as one micro-batch of inserts."""
    events = load(spark, sf_dir, "events")
    e = engine(spark, sf_dir, events=events.where("false"))
    v = e.view(event_totals("stream_events"))
    v.rebuild(confirm=True)
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    feed = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    stream_inserts(e, "events", feed, f"{e.config.state_dir}/stream").awaitTermination()
    return v.df()


@query("SELECT event_type, MAX(user_id) AS last_user, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_multi_batch(spark, sf_dir):
    """Change rows arrive in several micro-batches; each recomputes the groups it names."""
    events = load(spark, sf_dir, "events")
    e = engine(spark, sf_dir, events=events.where("event_id % 3 <> 0"))
    v = e.view(spec("stream_multi", Relation("events"), ["event_type"], [max_of("user_id", "last_user"), count_all("n")], feed="external"))
    v.rebuild(confirm=True)
    e.catalog.table("events").replace(events)
    rows = key_images(events.where("event_id % 3 <> 0"), events, ("event_id",), ("event_type",))
    source = f"{e.config.state_dir}/feed"
    rows.repartition(3, F.expr("after.event_id")).write.parquet(source)
    feed = spark.readStream.schema(change_schema(events.schema)).option("maxFilesPerTrigger", 1).parquet(source)
    stream_changes(e, "events", feed, f"{e.config.state_dir}/stream").awaitTermination()
    return v.df()
