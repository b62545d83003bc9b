"""Queries that run through the engine's SQL on stored entries: statements, pushdown to files, and connectors.

Each makes a store of its own in the shared folder named by ``spark.checkpoint.dir`` (a temporary one where it is unset, as
in tests), so what is compared went through files and back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.engine import Engine
from keyloom.plans.catalog import TABLES, base, kv, query


def folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    return f"{root}/keyloom-{uuid.uuid4().hex}"


def stored(spark: SparkSession, d: str, *names: str) -> Engine:
    """An engine whose server holds the entries of tables, with a foreign table for each and one of plain entries."""
    e = Engine(spark)
    e.sql(f"CREATE SERVER s FOREIGN DATA WRAPPER kv OPTIONS (db_path '{folder(spark)}', read_only 'false', create_if_missing 'true')")
    for n in names:
        t = TABLES[n]
        e.create_table(n, "s", t.projection.columns, key_pattern=t.pattern.pattern)
    e.sql("CREATE FOREIGN TABLE entries (key TEXT, value TEXT) SERVER s OPTIONS (table_mode 'raw')")
    e.servers["s"].store(spark).commit(kv(spark, d, *names))
    return e


def through_sql(name: str, tables: str, statements: list[str], sql: str, oracle: str | None = None) -> None:
    """Statements and then a query, all by the engine's SQL; the query over the plain tables is its oracle unless one is given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = stored(spark, d, *tables.split())
        for text in statements:
            e.sql(text)
        return e.sql(sql)

    query(oracle or sql, name)(run)


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
UPDATED = """SELECT CASE WHEN c_nationkey < 3 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'where c_acctbal = 1' ELSE c_name END AS c_name, c_nationkey,
CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""
UPDATES = ["UPDATE customer SET c_name = 'where c_acctbal = 1', c_acctbal = NULL WHERE c_mktsegment = 'BUILDING'", "UPDATE customer SET c_custkey = c_custkey + 1000000 WHERE c_nationkey < 3"]
NATION_NAMES = "SELECT 'geo:nation:' || n_nationkey || ':n_name' AS key, n_name AS value FROM nation"

through_sql(
    "sql_pushdown_one", "events", [],
    "SELECT event_type, user_id, event_id, value FROM events WHERE event_type = 'click'",
    "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, event_id, value FROM events WHERE event_type = 'click'",
)
through_sql(
    "sql_pushdown_alias", "events", [],
    "SELECT e.event_id, e.value FROM events AS e WHERE '7' = e.user_id AND e.event_type = 'click' AND e.value > 0",
    "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click' AND value > 0",
)
through_sql(
    "sql_pushdown_join", "events orders", [],
    "SELECT o.o_orderkey, e.event_id FROM orders o JOIN events e ON e.user_id = CAST(o.o_custkey AS STRING) WHERE o.o_orderstatus = 'F' AND e.event_type = 'click' AND e.value > 50",
    "SELECT o.o_orderkey, e.event_id FROM orders o JOIN events e ON e.user_id = o.o_custkey WHERE o.o_orderstatus = 'F' AND e.event_type = 'click' AND e.value > 50",
)
through_sql(
    "sql_pushdown_subquery", "events customer", [],
    "SELECT c_custkey FROM customer WHERE CAST(c_custkey AS STRING) IN (SELECT user_id FROM events WHERE event_type = 'view')",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view')",
)
through_sql(
    "sql_pushdown_range", "orders customer", [],
    "SELECT r.key, r.value FROM entries r WHERE r.key >= 'customer##1' AND 'customer##2' > r.key AND r.key LIKE '%##c_name'",
    "SELECT 'customer##' || c_custkey || '##c_name' AS key, c_name AS value FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '1%'",
)
through_sql(
    "store_insert", "customer", ["INSERT INTO customer (c_custkey, c_name) SELECT c_custkey + 1000000, concat('new ', c_name) FROM customer WHERE c_nationkey = 5"],
    CUSTOMERS, f"{CUSTOMERS} UNION ALL SELECT c_custkey + 1000000, 'new ' || c_name, NULL, NULL, NULL FROM customer WHERE c_nationkey = 5",
)
through_sql("store_update", "customer", UPDATES, CUSTOMERS, UPDATED)
through_sql(
    "store_delete", "customer nation", ["DELETE FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "DELETE FROM entries WHERE key LIKE 'customer##1##%'"],
    CUSTOMERS, f"{CUSTOMERS} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey <> 1",
)
through_sql(
    "store_raw", "nation", ["INSERT INTO entries VALUES ('zz/1', 'a'), ('zz/2', 'b'), ('zz/3', 'c')", "UPDATE entries SET value = upper(value) WHERE key > 'zz/1'", "DELETE FROM entries WHERE key = 'zz/3'"],
    "SELECT key, value FROM entries WHERE key >= 'zz/'", "SELECT * FROM (VALUES ('zz/1', 'a'), ('zz/2', 'B')) t(key, value)",
)
through_sql(
    "store_alter", "nation region", ["ALTER FOREIGN TABLE nation OPTIONS (ADD prefix_filter 'geo:nation:1')", "ALTER SERVER s OPTIONS (SET read_only 'true')"],
    "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%'",
)
through_sql(
    "store_import_schema", "nation", ["IMPORT FOREIGN SCHEMA found FROM SERVER s INTO public"],
    "SELECT * FROM found", "SELECT CAST(n_nationkey AS VARCHAR) AS col1, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
)


@query("SELECT 'Keys Scanned: ' || 3 * count(*) AS plan FROM events WHERE event_type = 'click' UNION ALL SELECT 'Prefix Filter: event_type=''click''' FROM region WHERE r_regionkey = 0")
def sql_explain(spark, d):
    said = stored(spark, d, "events").sql("EXPLAIN (ANALYZE) SELECT max(value) FROM events e WHERE e.event_type = 'click' GROUP BY user_id ORDER BY 1 LIMIT 2")
    return said.select(F.trim("plan").alias("plan")).where("plan LIKE 'Keys Scanned%' OR plan LIKE 'Prefix Filter%'")


@query(UPDATED)
def store_compact(spark, d):
    """The statements of store_update, with the deltas merged into a new snapshot after each."""
    e = stored(spark, d, "customer")
    for text in UPDATES:
        e.sql(text)
        e.compact("s")
    return e.sql(CUSTOMERS)


@query("SELECT count(*) AS updated, count(*) AS deleted FROM customer WHERE c_nationkey = 3")
def store_counts(spark, d):
    """How many rows statements report to have touched."""
    e = stored(spark, d, "customer")
    n = [e.sql(text).first()["rows"] for text in ("UPDATE customer SET c_name = 'x' WHERE c_nationkey = 3", "DELETE FROM customer WHERE c_name = 'x'")]
    return spark.createDataFrame([tuple(n)], "updated long, deleted long")


@query(NATION_NAMES)
def data_source_scan(spark, d):
    from keyloom.sources.datasource import NAME, register

    e = stored(spark, d, "nation")
    e.sql("DELETE FROM entries WHERE key LIKE '%:n_regionkey'")
    register(spark)
    return spark.read.format(NAME).option("path", e.servers["s"].options.db_path).load()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def leveldb_round_trip(spark, d):
    """Entries written to a LevelDB folder and imported into an empty store."""
    from keyloom.sources.leveldb_io import export_store, import_store

    e = stored(spark, d, "nation")
    e.sql("DELETE FROM nation")
    at = tempfile.mkdtemp()  # the driver's own disk, as the format allows one process only
    export_store(kv(spark, d, "nation"), f"{at}/db")
    import_store(spark, f"{at}/db", e.servers["s"].store(spark))
    return e.sql("SELECT * FROM nation")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def stream_maintain(spark, d):
    """A stream of operations applied to a store: all names put, then those of odd keys deleted."""
    from keyloom.streaming.incremental import maintain

    e = stored(spark, d, "customer")
    e.sql("DELETE FROM customer")
    at, schema = folder(spark), "key string, phase int, ord long, value string"
    rows = base(spark, d, "customer").select(F.concat(F.lit("customer##"), "c_custkey", F.lit("##c_name")).alias("key"), F.lit(1).alias("phase"), F.lit(0).cast("long").alias("ord"), F.col("c_name").alias("value"), "c_custkey")
    for ops in (rows, rows.where("c_custkey % 2 = 1").withColumns({"phase": F.lit(0), "value": F.lit(None).cast("string")})):
        ops.drop("c_custkey").write.mode("append").parquet(f"{at}/ops")
        maintain(spark.readStream.schema(schema).parquet(f"{at}/ops"), e.servers["s"].store(spark), f"{at}/ck").awaitTermination()
    return e.sql("SELECT c_custkey, c_name FROM customer")
