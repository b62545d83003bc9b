"""The queries of the engine and the SQL each is compared with.

Entries are made from the driver's tables inside each query, so the SQL side is plain SQL on those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import keyexpr
from keyloom.functions.pattern import KeyPattern
from keyloom.operators import discovery, dml
from keyloom.operators.tables import Bounds, PivotTable, RawTable
from keyloom.plans.projection import columns
from keyloom.streaming.notify import CHANNEL_LENGTH

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pivot(name: str, pattern: str, ddl: str, prefix_filter: str | None = None) -> PivotTable:
    return PivotTable.of(name, pattern, columns(ddl), prefix_filter)


CUSTOMER = pivot("customer", "customer##{c_custkey}##{attr}", "c_custkey BIGINT, c_name TEXT, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment TEXT")
EVENTS = pivot("events", "events##{event_type}##{user_id}##{event_id}##{attr}", "event_type TEXT, user_id TEXT, event_id BIGINT, ts TIMESTAMP, value DOUBLE, props TEXT")
ORDERS = pivot("orders", "this###{o_orderstatus}__{o_orderkey}##pat##{attr}", "o_orderstatus TEXT, o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority TEXT")
PART = pivot("part", "{p_size}:{p_type}/{p_partkey}/{attr}", "p_size INTEGER, p_type TEXT, p_partkey BIGINT, p_name TEXT, p_brand TEXT, p_retailprice DOUBLE")
NATION = pivot("nation", "geo:nation:{n_nationkey}:{attr}", "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER")
REGION = pivot("region", "geo:region:{r_regionkey}:{attr}", "r_regionkey INTEGER, r_name TEXT")
SUPPLIER = pivot("supplier", "supplier##{s_suppkey}##{attr}", "s_suppkey BIGINT, s_name TEXT, s_nationkey INTEGER, s_acctbal DOUBLE")
TABLES = {t.name: t for t in (CUSTOMER, EVENTS, ORDERS, PART, NATION, REGION, SUPPLIER)}


def kv(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The entries of tables, in one store."""
    out = None
    for n in names:
        rows = base(spark, sf_dir, n)
        if n == "events":
            rows = rows.withColumn("user_id", F.col("user_id").cast("string"))
        e = TABLES[n].encode(rows)
        out = e if out is None else out.unionByName(e)
    return out


def scan(spark: SparkSession, sf_dir: str, name: str, where: dict | None = None) -> DataFrame:
    return TABLES[name].scan(kv(spark, sf_dir, name), where)


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        scan(spark, sf_dir, n).createOrReplaceTempView(f"v_{n}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode customers as keys, read them back as a pivot table, and aggregate over it."""
    t = scan(spark, sf_dir, "customer")
    return t.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).alias("balance"), F.max("c_custkey").alias("last_key"))


# pivot scans

EV = "event_type, CAST(user_id AS VARCHAR) AS user_id, event_id, ts, value, props"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def pivot_full_scan(spark, d):
    return scan(spark, d, "customer")


@query(f"SELECT {EV} FROM events WHERE event_type = 'click'")
def pivot_prefix_scan_1(spark, d):
    return scan(spark, d, "events", {"event_type": "click"})


@query(f"SELECT {EV} FROM events WHERE event_type = 'click' AND user_id = 7")
def pivot_prefix_scan_2(spark, d):
    return scan(spark, d, "events", {"event_type": "click", "user_id": "7"})


@query(f"SELECT {EV} FROM events WHERE user_id = 7")
def pivot_nonleading_filter(spark, d):
    return scan(spark, d, "events", {"user_id": "7"})


@query("SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def pivot_mixed_delims(spark, d):
    return scan(spark, d, "orders")


@query("SELECT p_size, p_type, p_partkey, p_name, p_brand, p_retailprice FROM part")
def pivot_noprefix_pattern(spark, d):
    return scan(spark, d, "part")


@query(f"SELECT {EV} FROM events WHERE event_type = 'view'")
def pivot_column_order(spark, d):
    t = pivot("events", EVENTS.pattern.pattern, "value DOUBLE, event_id BIGINT, props TEXT, user_id TEXT, event_type TEXT, ts TIMESTAMP")
    return t.scan(kv(spark, d, "events"), {"event_type": "view"})


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def pivot_sparse_nulls(spark, d):
    t = pivot("c", "c##{c_custkey}##{attr}", "c_custkey BIGINT, c_name TEXT, c_acctbal DOUBLE, other TEXT")
    rows = base(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.lit("x").alias("other"))
    return t.scan(t.encode(rows)).drop("other")


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS absent FROM supplier")
def pivot_all_null_row(spark, d):
    return pivot("s", SUPPLIER.pattern.pattern, "s_suppkey BIGINT, absent TEXT").scan(kv(spark, d, "supplier"))


@query("SELECT n_nationkey, '' AS note, n_name FROM nation")
def pivot_empty_string(spark, d):
    t = pivot("n", "n/{n_nationkey}/{attr}", "n_nationkey INTEGER, note TEXT, n_name TEXT")
    return t.scan(t.encode(base(spark, d, "nation").withColumn("note", F.lit(""))))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pivot_skips_foreign_keys(spark, d):
    return NATION.scan(kv(spark, d, "region", "customer", "nation", "supplier", "part"))


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM supplier")
def pivot_attr_trailing(spark, d):
    e = base(spark, d, "supplier").select(F.concat(F.lit("s##"), "s_suppkey", F.lit("##s_name##extra")).alias("key"), F.col("s_name").alias("value"))
    return pivot("s", "s##{s_suppkey}##{attr}", "s_suppkey BIGINT, s_name TEXT").scan(e)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pivot_attr_mid_pattern(spark, d):
    t = pivot("n", "a/{attr}/{n_nationkey}", "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER")
    return t.scan(t.encode(base(spark, d, "nation")))


@query("SELECT 'r' AS config, 5 AS n FROM region LIMIT 1")
def pivot_no_captures(spark, d):
    t = pivot("cfg", "cfg/{attr}", "config TEXT, n INTEGER")
    e = spark.createDataFrame([("cfg/config", "r"), ("cfg/n", "5"), ("other", "x")], "key string, value string")
    return t.scan(e)


@query(
    """SELECT event_id, event_id % 2 = 0 AS flag, CAST(event_id % 1000 AS INTEGER) AS i, event_id * 1000003 AS l, CAST(event_id AS DECIMAL(18,2)) / 4 AS ignore_,
       CAST(ts AS DATE) AS day, ts, props AS t, encode(props) AS b FROM events""".replace("CAST(event_id AS DECIMAL(18,2)) / 4 AS ignore_", "CAST(CAST(event_id AS DECIMAL(12,2)) + 0.25 AS DECIMAL(12,2)) AS n")
)
def pivot_types(spark, d):
    t = pivot("t", "t:{event_id}:{attr}", "event_id BIGINT, flag BOOLEAN, i INTEGER, l BIGINT, n NUMERIC(12,2), day DATE, ts TIMESTAMP, t TEXT, b BYTEA")
    rows = base(spark, d, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("flag"), (F.col("event_id") % 1000).cast("int").alias("i"), (F.col("event_id") * 1000003).alias("l"), (F.col("event_id").cast("decimal(11,2)") + F.lit(0.25).cast("decimal(3,2)")).cast("decimal(12,2)").alias("n"), F.to_date("ts").alias("day"), "ts", F.col("props").alias("t"), F.col("props").cast("binary").alias("b"))
    return t.scan(t.encode(rows))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 4 AS n_attrs FROM customer")
def pivot_sparse_map(spark, d):
    return CUSTOMER.sparse(kv(spark, d, "customer")).select("c_custkey", F.size("attrs").alias("n_attrs"))


# raw scans

KEY = "'ord:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"
RAW = f"SELECT {KEY} AS key, o_orderpriority AS value FROM orders"


def raw_kv(spark, d):
    return base(spark, d, "orders").select(F.concat(F.lit("ord:"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("key"), F.col("o_orderpriority").alias("value")).unionByName(base(spark, d, "region").select(F.concat(F.lit("zone:"), "r_name").alias("key"), F.col("r_name").alias("value")))


@query(RAW + " UNION ALL SELECT 'zone:' || r_name, r_name FROM region")
def raw_full(spark, d):
    return RawTable("r").scan(raw_kv(spark, d))


@query(f"SELECT * FROM ({RAW}) WHERE key = 'ord:00000042'")
def raw_point(spark, d):
    return RawTable("r").scan(raw_kv(spark, d), Bounds(exact="ord:00000042"))


@query(f"SELECT * FROM ({RAW}) WHERE key >= 'ord:00000100' AND key < 'ord:00000200'")
def raw_range_ge_lt(spark, d):
    return RawTable("r").scan(raw_kv(spark, d), Bounds.of([(">=", "ord:00000100"), ("<", "ord:00000200")]))


@query(f"SELECT * FROM ({RAW}) WHERE key > 'ord:00000100' AND key <= 'ord:00000200'")
def raw_range_gt_le(spark, d):
    return RawTable("r").scan(raw_kv(spark, d), Bounds.of([(">", "ord:00000100"), ("<=", "ord:00000200")]))


@query("SELECT 'zone:' || r_name AS key, r_name AS value, CAST(NULL AS VARCHAR) AS note FROM region")
def raw_prefix_filter(spark, d):
    return RawTable("r", columns("key TEXT, value TEXT, note TEXT"), "zone:").scan(raw_kv(spark, d))


# keys

@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, a AS attr, count(*) AS n FROM customer, (VALUES ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(a) GROUP BY 1, 2")
def key_parse(spark, d):
    p = keyexpr.parse(CUSTOMER.pattern, F.col("key"))
    return kv(spark, d, "customer").where(p.valid).select(p.captures["c_custkey"].alias("c_custkey"), p.attr.alias("attr")).groupBy("c_custkey", "attr").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'this###' || o_orderstatus || '__' || o_orderkey || '##pat##total' AS key FROM orders")
def key_build(spark, d):
    caps = {"o_orderstatus": F.col("o_orderstatus"), "o_orderkey": F.col("o_orderkey").cast("string")}
    return base(spark, d, "orders").select(keyexpr.build(ORDERS.pattern, caps, F.lit("total"), strict=True).alias("key"))


@query("SELECT count(*) * 3 AS n, count(*) * 3 AS same FROM part")
def key_roundtrip(spark, d):
    rows = kv(spark, d, "part")
    p = keyexpr.parse(PART.pattern, F.col("key"))
    again = keyexpr.build(PART.pattern, p.captures, p.attr)
    return rows.where(p.valid).select(F.col("key"), again.alias("again")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("key") == F.col("again")).cast("long")).alias("same"))


@query("SELECT count(*) AS n FROM region WHERE false")
def key_nomatch(spark, d):
    p = keyexpr.parse(KeyPattern("u##{g}##{id}##{attr}"), F.col("key"))
    rows = base(spark, d, "region").select(F.explode(F.array(F.lit("u####2##n"), F.lit("x##1##2##n"), F.lit("u##1##2"), F.lit("u##1##2##"))).alias("key"))
    return rows.where(p.valid).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT split_part(key, ':', 1) || ':' AS prefix FROM (" + RAW + " UNION ALL SELECT 'zone:' || r_name, '' FROM region)")
def list_prefixes(spark, d):
    return discovery.list_prefixes(raw_kv(spark, d), depth=1)


# changes

CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def after(table: PivotTable, entries: DataFrame, ops: DataFrame) -> DataFrame:
    return table.scan(dml.apply_ops(entries, ops))


@query(f"{CUST} UNION ALL SELECT c_custkey + 1000000, c_name, NULL, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 5")
def dml_insert(spark, d):
    rows = base(spark, d, "customer").where("c_nationkey = 5").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit(None).cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")
    return after(CUSTOMER, kv(spark, d, "customer"), dml.insert_ops(CUSTOMER, rows))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'merged' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dml_insert_merge(spark, d):
    rows = base(spark, d, "customer").where("c_nationkey = 5").select("c_custkey", F.lit("merged").alias("c_name"))
    return after(CUSTOMER, kv(spark, d, "customer"), dml.insert_ops(CUSTOMER, rows))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update_attr(spark, d):
    e = kv(spark, d, "customer")
    return after(CUSTOMER, e, dml.update_ops(CUSTOMER, e, CUSTOMER.scan(e, raw_ids=True).where("c_mktsegment = 'BUILDING'"), {"c_acctbal": F.col("c_acctbal") + 1}))


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dml_update_null(spark, d):
    e = kv(spark, d, "customer")
    return after(CUSTOMER, e, dml.update_ops(CUSTOMER, e, CUSTOMER.scan(e, raw_ids=True).where("c_mktsegment = 'BUILDING'"), {"c_name": F.lit(None)}))


@query("SELECT c_custkey + CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END * 1000000 AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dml_update_identity(spark, d):
    e = kv(spark, d, "customer")
    return after(CUSTOMER, e, dml.update_ops(CUSTOMER, e, CUSTOMER.scan(e, raw_ids=True).where("c_nationkey < 10"), {"c_custkey": F.col("c_custkey") + 1000000}))


@query(f"{CUST} WHERE c_nationkey >= 10")
def dml_delete(spark, d):
    e = kv(spark, d, "customer")
    return after(CUSTOMER, e, dml.delete_ops(CUSTOMER, e, CUSTOMER.scan(e, raw_ids=True).where("c_nationkey < 10")))


@query("SELECT count(*) * 4 AS keys FROM customer WHERE c_nationkey >= 10")
def dml_delete_unprojected(spark, d):
    e = kv(spark, d, "customer")
    t = pivot("c", CUSTOMER.pattern.pattern, "c_custkey BIGINT, c_nationkey INTEGER")
    return dml.apply_ops(e, dml.delete_ops(t, e, t.scan(e, raw_ids=True).where("c_nationkey < 10"))).agg(F.count(F.lit(1)).alias("keys"))


@query(f"SELECT key, CASE WHEN key < 'ord:00000500' THEN '' ELSE value END AS value FROM ({RAW})")
def dml_raw_upsert(spark, d):
    e = raw_kv(spark, d).where("key < 'z'")
    return dml.apply_ops(e, dml.raw_put_ops(e.where("key < 'ord:00000500'").withColumn("value", F.lit(None).cast("string"))))


@query(f"SELECT key, CASE WHEN key < 'ord:00000500' THEN value || '!' ELSE value END AS value FROM ({RAW})")
def dml_raw_update(spark, d):
    e = raw_kv(spark, d).where("key < 'z'")
    return dml.apply_ops(e, dml.raw_update_ops(e.where("key < 'ord:00000500'"), F.concat("value", F.lit("!"))))


@query(f"SELECT key, value FROM ({RAW}) WHERE NOT key < 'ord:00000500'")
def dml_raw_delete(spark, d):
    e = raw_kv(spark, d).where("key < 'z'")
    return dml.apply_ops(e, dml.raw_delete_ops(e.where("key < 'ord:00000500'")))


@query("SELECT 3 * count(*) AS keys_written, count(*) AS keys_deleted FROM customer")
def dml_counters(spark, d):
    e = kv(spark, d, "customer")
    ops = dml.update_ops(CUSTOMER, e, CUSTOMER.scan(e, raw_ids=True), {"c_name": F.lit(None)})
    return ops.agg(F.sum((F.col("phase") == dml.PUT).cast("long")).alias("keys_written"), F.sum((F.col("phase") == dml.DEL).cast("long")).alias("keys_deleted"))


# discovery, notification, explain

ATTRS = "(VALUES ('c_acctbal'), ('c_mktsegment'), ('c_name'), ('c_nationkey')) t(name)"


@query(f"SELECT name, count(*) AS sample_count FROM customer, {ATTRS} GROUP BY name")
def discover_attrs(spark, d):
    return discovery.attrs(kv(spark, d, "customer"), CUSTOMER.pattern, max_keys=None).select("name", "sample_count")


@query("SELECT 'customer##{col1}##{attr}' AS pattern FROM region LIMIT 1")
def infer_pattern(spark, d):
    return spark.createDataFrame([(discovery.infer_pattern(kv(spark, d, "customer")),)], "pattern string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS col1, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def import_schema_scan(spark, d):
    e = kv(spark, d, "nation")
    p = KeyPattern(discovery.infer_pattern(e, 1000))
    t = PivotTable.of("imported", p.pattern, columns(discovery.columns_of(p, discovery.discover(e, p)["attrs"])))
    return t.scan(e)


@query("SELECT r_name, substr('public_' || repeat(r_name, 12) || '_changed', 1, 63) AS channel FROM region")
def notify_channel(spark, d):
    """The name as a Column expression, cut to as many characters as ``channel_name`` cuts it to."""
    name = F.concat(F.lit("public_"), F.repeat("r_name", 12), F.lit("_changed"))
    return base(spark, d, "region").select("r_name", F.substring(name, 1, CHANNEL_LENGTH).alias("channel"))


@query("SELECT 2 * count(*) + (SELECT count(*) FROM region) AS keys_scanned, (SELECT count(*) FROM region) AS keys_skipped, count(*) AS rows_returned FROM nation")
def explain_counters(spark, d):
    t = pivot("n", "geo:nation:{n_nationkey}:{attr}", "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER")
    stray = base(spark, d, "region").select(F.concat(F.lit("geo:nation:"), "r_name").alias("key"), F.lit("").alias("value"))
    return spark.createDataFrame([t.counters(kv(spark, d, "nation", "region").unionByName(stray))], "keys_scanned long, keys_skipped long, rows_returned long")


# Spark SQL over pivot views

def host(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query over views named v_<table>; the same text over the base tables is its oracle unless another is given."""
    names = tables.split()

    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *names)
        return spark.sql(sql)

    text = oracle or sql
    for n in names:
        text = text.replace(f"v_{n}", n)
    query(text, f"host_{name}")(run)


CO = "c.c_custkey, o.o_orderkey, o.o_totalprice"
host("join_inner", "customer orders", f"SELECT {CO} FROM v_customer c JOIN v_orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 7")
host("join_left", "customer orders", f"SELECT {CO} FROM v_customer c LEFT JOIN v_orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
host("join_right", "customer orders", f"SELECT {CO} FROM v_orders o RIGHT JOIN v_customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
host("join_full", "nation supplier", "SELECT n.n_name, s.s_suppkey FROM v_nation n FULL JOIN v_supplier s ON n.n_nationkey = s.s_nationkey + 3")
host("join_semi", "customer orders", "SELECT c_custkey FROM v_customer c WHERE EXISTS (SELECT 1 FROM v_orders o WHERE o.o_custkey = c.c_custkey)")
host("join_anti", "customer orders", "SELECT c_custkey FROM v_customer c WHERE NOT EXISTS (SELECT 1 FROM v_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
host("join_cross", "nation region", "SELECT n.n_name, r.r_name FROM v_nation n CROSS JOIN v_region r")
host("join_theta", "nation region", "SELECT n.n_name, r.r_name FROM v_nation n JOIN v_region r ON n.n_regionkey < r.r_regionkey")
host("join_range", "supplier nation", "SELECT s.s_suppkey, n.n_nationkey FROM v_supplier s JOIN v_nation n ON n.n_nationkey BETWEEN s.s_nationkey - 1 AND s.s_nationkey + 1")
host("join_three", "customer nation region", "SELECT r.r_name, count(*) AS n FROM v_customer c JOIN v_nation n ON c.c_nationkey = n.n_nationkey JOIN v_region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
host("agg", "customer", "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, sum(CAST(c_nationkey AS BIGINT)) AS s FROM v_customer GROUP BY c_mktsegment".replace("sum(CAST(c_nationkey AS BIGINT))", "CAST(sum(c_nationkey) AS BIGINT)"))
host("agg_distinct", "customer", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM v_customer GROUP BY c_mktsegment")
host("rollup", "part", "SELECT p_size, p_brand, count(*) AS n FROM v_part GROUP BY ROLLUP (p_size, p_brand)")
host("cube", "part", "SELECT p_brand, p_size % 3 AS s, count(*) AS n FROM v_part GROUP BY CUBE (p_brand, p_size % 3)", "SELECT p_brand, s, count(*) AS n FROM (SELECT p_brand, p_size % 3 AS s FROM part) GROUP BY CUBE (p_brand, s)")
host("grouping_sets", "events", "SELECT event_type, user_id, count(*) AS n FROM v_events GROUP BY GROUPING SETS ((event_type), (user_id), ())", "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
host("having", "orders", "SELECT o_custkey, count(*) AS n FROM v_orders GROUP BY o_custkey HAVING count(*) > 12")
host("filter_agg", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM v_orders GROUP BY o_orderpriority")
host("window_rank", "customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM v_customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS r, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS rn FROM customer")
host("window_lag", "orders", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM v_orders")
host("window_frame_rows", "events", "SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS m FROM v_events")
host("window_frame_range", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS n FROM v_orders")
host("ntile", "supplier", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_suppkey) AS q FROM v_supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_suppkey) AS INTEGER) AS q FROM supplier")
host("topk", "orders", "SELECT o_orderkey, o_totalprice FROM v_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
host("limit_offset", "customer", "SELECT c_custkey, c_name FROM v_customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
host("union", "nation region", "SELECT n_regionkey AS k FROM v_nation UNION SELECT r_regionkey FROM v_region")
host("union_all", "nation region", "SELECT n_regionkey AS k FROM v_nation UNION ALL SELECT r_regionkey FROM v_region")
host("intersect", "customer supplier", "SELECT c_nationkey AS k FROM v_customer INTERSECT SELECT s_nationkey FROM v_supplier")
host("intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM v_customer INTERSECT ALL SELECT s_nationkey FROM v_supplier")
host("except", "nation supplier", "SELECT n_nationkey AS k FROM v_nation EXCEPT SELECT s_nationkey FROM v_supplier WHERE s_suppkey % 7 = 0")
host("except_all", "customer supplier", "SELECT c_nationkey AS k FROM v_customer EXCEPT ALL SELECT s_nationkey FROM v_supplier")
host("in_subquery", "orders customer", "SELECT o_orderkey FROM v_orders WHERE o_custkey IN (SELECT c_custkey FROM v_customer WHERE c_mktsegment = 'BUILDING')")
host("scalar_subquery", "orders", "SELECT o_orderkey FROM v_orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.98 FROM v_orders)")
host("correlated", "customer", "SELECT c_custkey FROM v_customer a WHERE c_acctbal = (SELECT max(c_acctbal) FROM v_customer b WHERE b.c_nationkey = a.c_nationkey)")
host("cte", "customer nation", "WITH big AS (SELECT c_nationkey, count(*) AS n FROM v_customer GROUP BY c_nationkey) SELECT n_name, n FROM big JOIN v_nation ON c_nationkey = n_nationkey WHERE n > 1")
host("recursive", "region", "WITH RECURSIVE t(i) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT i + 1 FROM t WHERE i < 20) SELECT r_name, i FROM t JOIN v_region ON i % 5 = r_regionkey")
host("lateral", "nation supplier", "SELECT n.n_name, s.n AS suppliers FROM v_nation n, LATERAL (SELECT count(*) AS n FROM v_supplier s WHERE s.s_nationkey = n.n_nationkey) s")
host("case", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(c_name, '?') AS name, c_custkey % 7 AS m FROM v_customer")
host("like", "part", "SELECT p_partkey FROM v_part WHERE p_type LIKE '%MALL' AND p_name LIKE 'r__ %'")
host("in_list", "part", "SELECT p_partkey FROM v_part WHERE p_size IN (1, 5, 9) AND p_brand IN ('Brand#1', 'Brand#2')")
host("strings", "customer", "SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS n, substr(c_name, 3, 4) AS s, replace(c_name, 'C', 'K') AS r, c_name || '-' || c_mktsegment AS j, trim(c_name) AS t FROM v_customer", "SELECT c_custkey, upper(c_mktsegment) AS u, CAST(length(c_name) AS INTEGER) AS n, substr(c_name, 3, 4) AS s, replace(c_name, 'C', 'K') AS r, c_name || '-' || c_mktsegment AS j, trim(c_name) AS t FROM customer")
host("dates", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS mon, CAST(o_orderdate AS DATE) AS day FROM v_orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, date_trunc('month', o_orderdate) AS mon, CAST(o_orderdate AS DATE) AS day FROM orders")
host("math", "part", "SELECT p_partkey, abs(p_retailprice - 1000) AS a, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, sqrt(p_retailprice) AS q, p_size * 2 + 1 AS x FROM v_part", "SELECT p_partkey, abs(p_retailprice - 1000) AS a, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, sqrt(p_retailprice) AS q, p_size * 2 + 1 AS x FROM part")
host("json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM v_events", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
host("arrays", "nation", "SELECT n_regionkey, size(collect_set(n_name)) AS n, array_join(sort_array(collect_list(n_name)), ',') AS names FROM v_nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(count(DISTINCT n_name) AS INTEGER) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
host("series", "region", "SELECT r_name, i FROM v_region LATERAL VIEW explode(sequence(0, r_regionkey)) s AS i", "SELECT r_name, CAST(unnest(generate_series(0, r_regionkey)) AS INTEGER) AS i FROM region")


@query("SELECT o.o_orderkey, e.event_id FROM (SELECT *, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F') o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")
def host_join_asof(spark, d):
    """The last event of the customer before each order: both sides in one sorted stream, the last event carried on."""
    o = scan(spark, d, "orders", {"o_orderstatus": "F"}).select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    e = scan(spark, d, "events").select(F.col("user_id").cast("long").alias("k"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).select("*", F.last("event_id", ignorenulls=True).over(w).alias("last")).where("o_orderkey is not null").select("o_orderkey", F.col("last").alias("event_id"))
