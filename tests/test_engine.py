import random

import pytest
from pyspark.sql import functions as F

from keyloom.engine import Engine, ServerOptions, check_table_options
from keyloom.errors import ConfigError, ConflictError, InvalidOptionName, InvalidOptionValue, KvError, MissingOption, StoreError, TypeConversionError
from keyloom.functions.pattern import KeyPattern
from keyloom.operators import discovery, dml
from keyloom.operators.tables import Bounds, PivotTable
from keyloom.plans import pushdown
from keyloom.plans.projection import columns
from keyloom.sources.store import KvStore, WriteBatch
from keyloom.streaming.notify import channel_name, changes

BEDS = "bed|{house}|{plot}|{attr}"
BED_COLS = "house TEXT, plot TEXT, crop TEXT, sown TEXT, keeper TEXT"


@pytest.fixture
def engine(spark, tmp_path):
    """A garden: beds in houses, harvests by a pattern of several delimiters, probes without a literal prefix, plain cells."""
    e = Engine(spark)
    e.sql(f"CREATE SERVER garden FOREIGN DATA WRAPPER kv OPTIONS (db_path '{tmp_path}/db', read_only 'false', create_if_missing 'true')")
    e.sql(f"CREATE FOREIGN TABLE beds ({BED_COLS}) SERVER garden OPTIONS (key_pattern '{BEDS}')")
    e.sql("CREATE FOREIGN TABLE harvest (kind TEXT, week TEXT, kilos TEXT, crates TEXT, loss TEXT) SERVER garden OPTIONS (key_pattern 'yield={kind}~{week}/q/{attr}')")
    e.sql("CREATE FOREIGN TABLE probes (site TEXT, line TEXT, unit TEXT, moist TEXT, warm TEXT) SERVER garden OPTIONS (key_pattern '{site}.{line}@{unit}.{attr}')")
    e.sql("CREATE FOREIGN TABLE cells (key TEXT, value TEXT) SERVER garden OPTIONS (table_mode 'raw')")
    return e


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def plant(engine):
    engine.sql("INSERT INTO beds VALUES ('north','p1','leek','march',NULL), ('north','p2','kale','april','Ines'), ('south','p1','chard',NULL,'Omar')")


def test_scans_of_all_kinds_of_patterns(engine):
    plant(engine)
    engine.sql("INSERT INTO harvest (kind, week, kilos) VALUES ('leek','w31','12.5')")
    engine.sql("INSERT INTO harvest VALUES ('kale','w30','7','2','0.4'), ('kale','w31','9',NULL,'0.1')")
    engine.sql("INSERT INTO probes VALUES ('hill','a','u1','31',NULL), ('hill','b','u1','28','17'), ('dale','a','u2',NULL,'19')")
    assert got(engine.sql("SELECT plot, crop, keeper FROM beds WHERE house = 'north'")) == [("p1", "leek", None), ("p2", "kale", "Ines")]
    assert engine.kv("beds").where("key like 'bed|%'").count() == 7
    assert got(engine.sql("SELECT * FROM harvest")) == [("kale", "w30", "7", "2", "0.4"), ("kale", "w31", "9", None, "0.1"), ("leek", "w31", "12.5", None, None)]
    assert got(engine.sql("SELECT site, unit, warm FROM probes WHERE line = 'a'")) == [("dale", "u2", "19"), ("hill", "u1", None)]
    assert "StringStartsWith(key,bed|north|)" in plan_of(engine.table("beds", {"house": "north"}))


ODD = "o'b\\k"  # a quote and a backslash


@pytest.mark.parametrize(
    "query,prefix",
    [
        ("SELECT * FROM beds WHERE house = 'north'", "bed|north|"),
        ("SELECT crop FROM beds b WHERE b.house = 'north' AND 'p2' = b.plot ORDER BY crop LIMIT 3", "bed|north|p2|"),
        ("SELECT b.crop, h.kilos FROM beds b JOIN harvest h ON b.crop = h.kind WHERE b.house = 'north' AND h.kind = 'kale'", "bed|north|"),
        ("SELECT b.crop, h.kilos FROM beds AS b LEFT JOIN harvest h ON h.kind = b.crop AND h.week = 'w31' WHERE b.house = concat('no', 'rth')", "bed|north|"),
        ("SELECT * FROM harvest WHERE kind IN (SELECT crop FROM beds WHERE house = 'north')", "bed|north|"),
        ("SELECT (SELECT max(crop) FROM beds WHERE house = 'north') AS m, count(*) AS n FROM harvest", "bed|north|"),
        ("WITH n AS (SELECT * FROM beds) SELECT * FROM n WHERE house = 'north' AND plot <> 'p9'", "bed|north|"),
        (f"SELECT * FROM beds WHERE house = 'north' AND plot = '{ODD.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'", f"bed|north|{ODD}|"),
        (f"SELECT * FROM beds WHERE house = 'north' AND plot = r\"{ODD}\"", f"bed|north|{ODD}|"),
        ("SELECT * FROM beds x JOIN beds y ON x.plot = y.plot WHERE x.house = 'north' AND y.house = 'south'", "bed|south|"),
        ("SELECT * FROM beds WHERE house = 'north' OR keeper = 'Omar'", None),
        ("SELECT * FROM beds WHERE NOT house = 'north'", None),
        ("SELECT * FROM beds WHERE house = 'north' UNION ALL SELECT * FROM beds", None),
        ("SELECT * FROM harvest h LEFT JOIN beds b ON b.crop = h.kind AND b.house = 'north'", "bed|north|"),
        ("SELECT * FROM beds b LEFT JOIN harvest h ON b.crop = h.kind AND b.house = 'north'", None),
        ("SELECT house, 'north' = house AS here, count(*) AS n FROM beds GROUP BY house HAVING house >= 'n'", None),
    ],
)
def test_sql_narrows_scans_without_changing_rows(engine, query, prefix):
    plant(engine)
    engine.insert("beds", [{"house": "north", "plot": ODD, "crop": "rue"}])
    engine.sql("INSERT INTO harvest VALUES ('kale','w31','9','3',NULL), ('leek','w30','4',NULL,NULL), ('fig','w30','1',NULL,NULL)")
    narrow = engine.sql(query)
    for t in engine.named(query):
        assert engine.spark.table(t).count() == engine.table(t).count()  # the views are whole again
        engine.table(t).createOrReplaceTempView(t)
    assert got(narrow) == got(engine.spark.sql(query))
    assert ("StringStartsWith(key,bed|north|" in plan_of(narrow) or "StringStartsWith(key,bed|south|" in plan_of(narrow)) == (prefix is not None)
    assert prefix is None or f"StringStartsWith(key,{prefix})" in plan_of(narrow)


def test_changes_of_rows(engine):
    one = "SELECT crop, sown, keeper FROM beds WHERE house = 'west' AND plot = 'p7'"
    engine.sql("INSERT INTO beds (house, plot, crop, sown) VALUES ('west','p7','beet','may')")
    assert got(engine.sql(one)) == [("beet", "may", None)]
    engine.sql("UPDATE beds SET keeper = 'Lu where ever', sown = 'june = hot' WHERE house = 'west' AND plot = 'p7'")
    assert got(engine.sql(one)) == [("beet", "june = hot", "Lu where ever")]
    engine.sql("UPDATE beds SET keeper = NULL, sown = NULL, crop = upper(crop) WHERE plot = 'p7'")
    assert got(engine.sql(one)) == [("BEET", None, None)] and [r[0] for r in engine.kv("beds").collect()] == ["bed|west|p7|crop"]
    engine.sql("INSERT INTO cells VALUES ('bed|west|p7|undeclared', 'u')")
    assert engine.sql("DELETE FROM beds WHERE plot = 'p7';").first()["rows"] == 1
    assert engine.table("beds").count() == 0 and engine.kv("beds").count() == 0


def test_statements_over_many_rows(engine):
    engine.sql("INSERT INTO beds SELECT 'long', concat('p', i), concat('crop ', i % 7), NULL, concat('k', i) FROM (SELECT explode(sequence(1, 60)) AS i)")
    assert engine.sql("UPDATE beds SET sown = 'late' WHERE plot LIKE 'p3%'").first()["rows"] == 11
    assert engine.sql("DELETE FROM beds WHERE sown = 'late'").first()["rows"] == 11 and engine.sql("SELECT count(*) FROM beds").first()[0] == 49
    assert engine.sql("UPDATE beds SET house = 'short' WHERE plot IN ('p4', 'p5')").first()["rows"] == 2
    assert got(engine.sql("SELECT plot, crop, keeper FROM beds WHERE house = 'short'")) == [("p4", "crop 4", "k4"), ("p5", "crop 5", "k5")]
    assert engine.sql("DELETE FROM beds WHERE plot IN (SELECT plot FROM beds WHERE house = 'short')").first()["rows"] == 2
    engine.sql("DELETE FROM beds")
    assert engine.kv("beds").count() == 0


def test_input_is_evaluated_once(engine):
    rows = engine.spark.range(200).selectExpr("'r' as house", "concat('p', id) as plot", "'x' as crop").where("rand() < 0.5")
    n = engine.insert("beds", rows)
    assert n == engine.table("beds").count() == engine.sql("UPDATE beds SET house = 'q', crop = CAST(rand() AS STRING)").first()["rows"]
    assert engine.table("beds", {"house": "q"}).count() == n and engine.table("beds").count() == n


def test_plain_entries(engine):
    engine.sql("INSERT INTO cells VALUES ('m/1','one'), ('m/2','two'), ('m/3','three'), ('m/9','nine'), ('n','other')")
    keys = lambda where: [r[0] for r in engine.sql(f"SELECT key FROM cells c WHERE {where} ORDER BY key").collect()]
    assert keys("key LIKE 'm/%'") == ["m/1", "m/2", "m/3", "m/9"] and keys("key = 'm/2'") == ["m/2"] and keys("key = 'm/2' AND key = 'm/3'") == []
    assert keys("key >= 'm/2' AND key < 'm/9'") == ["m/2", "m/3"] and keys("c.key > 'm/1' AND 'm/3' >= c.key") == ["m/2", "m/3"]
    assert "GreaterThanOrEqual(key,m/2)" in plan_of(engine.sql("SELECT value FROM cells AS c WHERE c.key >= 'm/2'"))
    engine.sql("UPDATE cells SET value = 'zwei', key = 'ignored' WHERE key = 'm/2'")
    store = engine.servers["garden"].store(engine.spark)
    assert store.get("m/2") == "zwei"
    engine.sql("DELETE FROM cells WHERE key = 'm/3'")
    assert keys("key LIKE 'm/%'") == ["m/1", "m/2", "m/9"]
    engine.insert("cells", [{"key": "k", "value": None}])
    assert store.get("k") == ""
    with pytest.raises(Exception, match="key column cannot be NULL"):
        engine.insert("cells", [{"key": None, "value": "x"}])


def test_explain(engine):
    plant(engine)
    text = lambda q: "\n".join(r[0] for r in engine.sql(q).collect())
    said = text("EXPLAIN (ANALYZE, COSTS OFF) SELECT house, count(*) FROM beds b WHERE b.house = 'north' AND keeper = 'Ines' GROUP BY house ORDER BY 2 LIMIT 3")
    assert "Foreign Scan on beds" in said and "Prefix Filter: house='north'" in said and "Keys Scanned: 5" in said and "Keys Skipped: 0" in said and "Rows Returned: 2" in said
    assert "TakeOrderedAndProject" in said and "StringStartsWith(key,bed|north|)" in said  # the plan of the rest
    said = text("EXPLAIN ANALYZE SELECT * FROM cells WHERE key >= 'bed|north|' AND 'bed|north|p1~' > key ORDER BY key")
    assert "Key Bounds: key>='bed|north|', key<'bed|north|p1~'" in said and "Keys Scanned: 2" in said
    both = text("EXPLAIN SELECT * FROM beds x JOIN beds y ON x.plot = y.plot WHERE x.house = 'north' AND y.house = 'south'")
    assert both.count("Foreign Scan on beds") == 2 and "house='north'" in both and "house='south'" in both


def test_options():
    for options, kind in (({"table_mode": "raw", "key_pattern": BEDS}, InvalidOptionName), ({}, MissingOption), ({"table_mode": "pivot"}, MissingOption), ({"table_mode": "sideways"}, InvalidOptionValue), ({"key_pattern": "x/{y}"}, InvalidOptionValue), ({"pattern": "x"}, InvalidOptionName)):
        with pytest.raises(kind):
            check_table_options(options)
    assert check_table_options({"table_mode": "raw"}) == "raw" and check_table_options({"key_pattern": BEDS}) == "pivot"
    o = ServerOptions.of({"db_path": "/d", "block_cache_size": "3M", "read_only": "off", "write_buffer_size": "512KB"})
    assert o.block_cache_size == 3 << 20 and not o.read_only and o.write_buffer_size == 512 << 10
    for options, kind in (({}, MissingOption), ({"db_path": ""}, InvalidOptionValue), ({"db_path": "d", "dbpath": "d"}, InvalidOptionName), ({"db_path": "d", "read_only": "perhaps"}, InvalidOptionValue), ({"db_path": "d", "block_cache_size": "3Z"}, InvalidOptionValue)):
        with pytest.raises(kind):
            ServerOptions.of(options)


def test_altered_options(engine):
    plant(engine)
    engine.sql("ALTER SERVER garden OPTIONS (SET read_only 'true', ADD write_buffer_size '1M')")
    with pytest.raises(StoreError, match="read-only"):
        engine.delete("beds")
    engine.sql("ALTER SERVER garden OPTIONS (SET read_only 'off', DROP write_buffer_size)")
    assert engine.servers["garden"].options.write_buffer_size == ServerOptions("x").write_buffer_size
    engine.sql("ALTER FOREIGN TABLE beds OPTIONS (ADD prefix_filter 'bed|south|')")
    assert engine.table("beds").count() == 1
    engine.sql("ALTER FOREIGN TABLE beds OPTIONS (DROP prefix_filter)")
    assert engine.table("beds").count() == 3
    for bad in ("ALTER SERVER garden OPTIONS (ADD read_only 'on')", "ALTER SERVER garden OPTIONS (DROP use_write_batch)", "ALTER SERVER garden OPTIONS (SET db_path '')", "ALTER FOREIGN TABLE beds OPTIONS (DROP key_pattern)", "ALTER SERVER none OPTIONS (ADD read_only 'on')"):
        with pytest.raises(ConfigError):
            engine.sql(bad)
    assert engine.table("beds").count() == 3


def test_direct_mode(engine, tmp_path):
    engine.create_server("direct", db_path=f"{tmp_path}/direct", read_only="false", create_if_missing="true", use_write_batch="false")
    engine.create_table("d", "direct", "a TEXT, x TEXT, y TEXT", key_pattern="d/{a}/{attr}")
    engine.sql("INSERT INTO d VALUES ('1','p','q'), ('2','r',NULL)")
    engine.sql("UPDATE d SET a = '3', y = 'new' WHERE a = '1'")
    assert got(engine.table("d")) == [("2", "r", None), ("3", "p", "new")]


def test_read_only_and_drops(spark, tmp_path, engine):
    plant(engine)
    ro = Engine(spark)
    ro.create_server("s", db_path=f"{tmp_path}/db")
    ro.create_table("rows", "s", BED_COLS, key_pattern=BEDS)
    assert ro.table("rows").count() == 3
    for act in (lambda: ro.insert("rows", [{"house": "a", "plot": "1", "crop": "n"}]), lambda: ro.delete("rows")):
        with pytest.raises(StoreError, match="Cannot create writer for read-only connection"):
            act()
    with pytest.raises(StoreError, match="Failed to open"):
        KvStore(spark, f"{tmp_path}/none")
    with pytest.raises(ConfigError):
        engine.sql("DROP SERVER garden")
    engine.sql("DROP SERVER IF EXISTS other")
    engine.sql("DROP FOREIGN TABLE IF EXISTS harvest")
    engine.sql("DROP SERVER garden CASCADE")
    assert not engine.tables


def test_null_identity_and_strict(engine):
    with pytest.raises(Exception, match="Cannot insert row with NULL identity column"):
        engine.insert("beds", [{"house": None, "plot": "1", "crop": "n"}])
    with pytest.raises(Exception, match="read back differently"):
        engine.insert("beds", [{"house": "a|b", "plot": "1", "crop": "n"}], strict=True)
    assert engine.kv("beds").count() == 0
    assert engine.insert("beds", [{"house": "g", "plot": "1"}]) == 1
    assert engine.table("beds").count() == 0  # all attributes NULL: no key, no row
    engine.insert("beds", [{"house": "g", "plot": "1", "crop": ""}])
    assert got(engine.table("beds").select("crop")) == [("",)]


def test_notify(engine, spark):
    heard = []
    for t in ("beds", "cells"):
        engine.listen(channel_name("public", t), heard.append)
    engine.sql("LISTEN public_beds_changed")
    plant(engine)
    engine.sql("UPDATE beds SET crop = 'none' WHERE plot = 'p99'")  # touches nothing
    engine.sql("DELETE FROM beds WHERE plot = 'p1'")
    engine.sql("INSERT INTO cells VALUES ('c','v')")
    assert engine.notifications() == ["public_beds_changed"] * 2 and engine.notifications() == []
    engine.sql("UNLISTEN *")
    engine.sql("DELETE FROM cells WHERE key = 'c'")
    assert heard == ["public_beds_changed"] * 2 + ["public_cells_changed"] and engine.notifications() == []
    assert channel_name("public", "t" * 80) == ("public_" + "t" * 80)[:63]
    log = changes(spark, engine.servers["garden"].options.db_path + "/_changes")
    q = log.writeStream.format("memory").queryName("heard").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("heard").count() == 4


def test_discovery(engine, spark):
    plots = [("hut", "p1", "crop sown"), ("hut", "p2", "crop"), ("barn", "p3", "crop sown keeper")]
    engine.insert("cells", [{"key": f"found:{h}:{p}:{a}", "value": a.upper()} for h, p, attrs in plots for a in attrs.split()])
    ddl = engine.sql("IMPORT FOREIGN SCHEMA seen FROM SERVER garden INTO public").first()["status"]
    assert ddl.startswith("CREATE FOREIGN TABLE seen (col1 TEXT, col2 TEXT, crop TEXT, sown TEXT, keeper TEXT) SERVER garden OPTIONS (key_pattern '")
    assert got(engine.table("seen"))[0] == ("barn", "p3", "CROP", "SOWN", "KEEPER") and engine.table("seen").count() == 3
    kv = spark.createDataFrame([(k, "v") for k in ("tool##saw##1##edge", "tool##saw##1##grip", "tool##saw##2##edge", "tool##axe##1##edge", "tool##axe##1##wood", "seed:a/b", "leaf_x__y")], "key string, value string")
    p = KeyPattern("tool##{kind}##{n}##{attr}")
    d = discovery.discover(kv, p)
    assert (d["keys_scanned"], d["keys_matched"], [a["name"] for a in d["attrs"]]) == (5, 5, ["edge", "grip", "wood"])
    assert discovery.discover(kv, p, prefix_filter="tool##saw##")["keys_matched"] == 3
    assert discovery.discover(kv, p, max_keys=2)["keys_scanned"] == 2
    assert discovery.discover(kv, KeyPattern("none/{a}/{attr}")) == {"attrs": [], "keys_scanned": 0, "keys_matched": 0}
    assert {"tool##", "seed:"} <= {r[0] for r in discovery.list_prefixes(kv, 1).collect()} and discovery.list_prefixes(kv, 0).count() == 0
    assert discovery.infer_pattern(kv.where("key like 'tool%'")) == "tool##{col1}##{col2}##{attr}"
    assert discovery.infer_pattern_of(["x1/y1/z1", "x1/y2/z2", "x2/y2/z2"]) == "{col1}/{col2}/{attr}"
    assert discovery.infer_pattern_of([]) is None and discovery.infer_pattern_of(["alone"]) is None


def test_bounds(spark):
    keys = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    within = lambda *clauses: "".join(r[0] for r in keys.where(Bounds.of(list(clauses)).condition(F.col("key"))).collect())
    assert within((">=", "b"), ("<", "d"), (">", "b"), ("<=", "x")) == "c" and Bounds.of([(">=", "b"), ("<", "d"), (">", "b")]).text() == "key>'b', key<'d'"
    assert within(("=", "b"), ("=", "c")) == "" and within(("=", "b"), ("=", "b")) == "b" and within(("=", "b"), (">", "b")) == "" and within() == "abcde"
    assert Bounds().is_unbounded and Bounds(exact="a").is_exact
    with pytest.raises(ConfigError):
        Bounds.of([("<>", "x")])


def test_shifted_identities(engine):
    engine.create_table("n", "garden", "id INTEGER, v TEXT", key_pattern="n/{id}/{attr}")
    engine.insert("n", [{"id": i, "v": str(i)} for i in range(1, 4)])
    engine.update("n", {"id": F.col("id") + 1})
    assert got(engine.table("n")) == [(2, "1"), (3, "2"), (4, "3")]
    engine.sql("INSERT INTO cells VALUES ('n/007/v', 'seven')")
    assert engine.sql("SELECT v FROM n WHERE id = 7").count() == 1 and engine.table("n", {"id": 7}).count() == 1 and engine.delete("n", {"id": 7}) == 1
    assert engine.table("n").count() == 3


def test_random_changes_against_a_model(spark):
    """Sequences of statements on entries, against a dict of keys."""
    rng = random.Random(3)
    t = PivotTable.of("t", "t/{a}/{b}/{attr}", columns("a TEXT, b TEXT, x TEXT, y INTEGER"))
    model = {f"t/{a}/{b}/{c}": "1" for a in "pq" for b in "uv" for c in ("x", "y", "z")} | {"stray": "s"}
    for step in range(8):
        kv = spark.createDataFrame(sorted(model.items()), "key string, value string")
        a, b, v = rng.choice("pqr"), rng.choice("uvw"), rng.choice([None, 5, 7])
        kind = rng.choice(["insert", "update", "move", "delete"])
        if kind == "insert":
            ops = dml.insert_ops(t, spark.createDataFrame([(a, b, "n", v)], "a string, b string, x string, y int"))
            model[f"t/{a}/{b}/x"] = "n"
            if v is not None:
                model[f"t/{a}/{b}/y"] = str(v)
        else:
            old = t.scan(kv, raw_ids=True).where(F.col("a") == a)
            hit = sorted({k.split("/")[2] for k in model if k.startswith(f"t/{a}/")})
            if kind == "update":
                ops = dml.update_ops(t, kv, old, {"y": F.lit(v)})
                for u in hit:
                    model.pop(f"t/{a}/{u}/y", None)
                    if v is not None:
                        model[f"t/{a}/{u}/y"] = str(v)
            elif kind == "move":
                ops = dml.update_ops(t, kv, old, {"a": F.lit("m")})
                for u in hit:
                    cells = {c: model.get(f"t/{a}/{u}/{c}") for c in "xy"}
                    for k in [k for k in model if k.startswith(f"t/{a}/{u}/")]:
                        del model[k]
                    model |= {f"t/m/{u}/{c}": x for c, x in cells.items() if x is not None}
            else:
                ops = dml.delete_ops(t, kv, old)
                model = {k: x for k, x in model.items() if not k.startswith(f"t/{a}/")}
        assert dict(map(tuple, dml.apply_ops(kv, ops).collect())) == model, (step, kind, a, b, v)


def test_store_versions_and_batch(spark, tmp_path):
    store = KvStore(spark, f"{tmp_path}/kv", create_if_missing=True, read_only=False, keep=2)
    for i in range(4):
        with WriteBatch(store) as b:
            b.put("a", str(i))
            b.put("b", "x")
            b.delete("b")
            assert b.pending_count == 3
            b.commit()
            b.commit()
            assert not b.has_pending
    with WriteBatch(store) as b:
        b.put("lost", "x")
    assert store.version == 4 and len(store.current()) == 5 and store.get("a") == "3" and store.get("b") is None and store.get("lost") is None
    with pytest.raises(StoreError):
        WriteBatch(KvStore(spark, f"{tmp_path}/kv"))


OPS = "key string, phase int, ord long, value string"


def test_writers_that_interleave(spark, tmp_path, monkeypatch):
    a, b = (KvStore(spark, f"{tmp_path}/kv", create_if_missing=True, read_only=False) for _ in range(2))
    ops = lambda *rows: spark.createDataFrame(list(rows), OPS)
    point, raced = KvStore._point, []

    def late(self, state):
        if self is a and not raced:
            raced.append(b.apply(ops(("y", 1, 0, "b"), ("z", 1, 1, "b"))))
        point(self, state)

    monkeypatch.setattr(KvStore, "_point", late)
    assert a.apply(ops(("x", 1, 0, "a"), ("z", 1, 1, "a"))) == 2 and raced == [1]
    assert dict(map(tuple, b.read().collect())) == {"x": "a", "y": "b", "z": "a"}  # the later of two puts wins
    seen = a.state()
    b.apply(ops(("x", 0, 0, None)))
    with pytest.raises(ConflictError):
        a.apply(ops(("x", 1, 0, "stale")), based_on=seen)
    raced.clear()
    before = a.version
    a.compact()  # a write in between stays a delta
    assert a.version == before + 1 and len(a.current()) == 2 and dict(map(tuple, a.read().collect())) == {"y": "b", "z": "b"}


def test_overtaken_statement_runs_again(engine, monkeypatch):
    plant(engine)
    other = KvStore(engine.spark, engine.servers["garden"].options.db_path, read_only=False)
    apply, raced = KvStore.apply, []

    def late(self, ops, based_on=None):
        if self is not other and not raced:
            raced.append(apply(other, engine.spark.createDataFrame([("bed|north|p3|crop", 1, 0, "dill")], OPS)))
        return apply(self, ops, based_on)

    monkeypatch.setattr(KvStore, "apply", late)
    assert engine.update("beds", {"keeper": "all"}, {"house": "north"}) == 3  # the new row is seen by the second run
    assert got(engine.sql("SELECT plot, keeper FROM beds WHERE house = 'north'")) == [("p1", "all"), ("p2", "all"), ("p3", "all")]


def test_deltas_are_folded_and_merged(spark, tmp_path, monkeypatch):
    from keyloom.sources import store as module

    store = KvStore(spark, f"{tmp_path}/kv", create_if_missing=True, read_only=False, keep=1)
    store.commit(spark.createDataFrame([(f"k{i}", "0") for i in range(9)], module.SCHEMA))
    ops = lambda *rows: spark.createDataFrame(list(rows), OPS)
    store.apply(ops(("k1", 1, 0, "a"), ("k2", 0, 1, None), ("k1", 1, 2, "b")))
    store.apply(ops(("k2", 1, 0, "c"), ("k1", 0, 1, None), ("new", 1, 2, "n")))
    want = {f"k{i}": "0" for i in range(9) if i != 1} | {"k2": "c", "new": "n"}
    for small in (1 << 20, 0):
        monkeypatch.setattr(module, "BROADCAST_BYTES", small)
        assert dict(map(tuple, store.read().collect())) == want and len(store.current()) == 3
    assert "StringStartsWith(key,k3)" in plan_of(store.read().where(F.col("key").startswith("k3")))
    monkeypatch.setattr(module, "MOST", 2)
    base = store.current()[0]
    store.apply(ops(("k3", 0, 0, None)))
    want.pop("k3")
    assert store.current()[0] == base and len(store.current()) == 2  # deltas became one, the snapshot stands
    assert dict(map(tuple, store.read().collect())) == want and store.version == 4
    store.compact()
    assert len(store.current()) == 1 and dict(map(tuple, store.read().collect())) == want and store.version == 4
    store.apply(ops(("k4", 0, 0, None)))
    assert set(store.current()) <= set(store.versions()) and len(store.versions()) <= 3


def test_what_counts_as_a_query():
    assert pushdown.is_query(" (SELECT 1)") and pushdown.is_query("WITH x AS (SELECT 1) SELECT * FROM x") and pushdown.is_query("-- why\nFROM t")
    assert not pushdown.is_query("CREATE TABLE t AS SELECT 1") and not pushdown.is_query("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x") and not pushdown.is_query("DROP VIEW t")


def test_data_source(spark, engine):
    from keyloom.sources.datasource import register

    engine.insert("cells", [{"key": f"k{i}", "value": str(i)} for i in range(20)])
    load = lambda push=False: spark.read.format("keyloom_kv").option("path", engine.servers["garden"].options.db_path).option("push_filters", push).load()
    register(spark)
    for push in (False, True):
        df = load()
        for where, n in (("key >= 'k18' and key < 'k2'", 2), ("key like 'k1%'", 11), ("key in ('k3','k4','zz')", 2), ("key = 'k5'", 1), ("key > 'k8' and key <= 'k9'", 1)):
            assert (load(True) if push else df).where(where).count() == n
    engine.sql("UPDATE cells SET value = 'new' WHERE key = 'k5'")
    engine.sql("DELETE FROM cells WHERE key = 'k3'")
    assert got(load().where("key = 'k5'")) == [("k5", "new")] and load().where("key = 'k3'").count() == 0 and load().count() == 19


def test_data_source_of_several_files(spark, tmp_path):
    """Each task has the changes of its own file's keys, those before the first and after the last key included."""
    from keyloom.sources.datasource import KvReader, register

    store = KvStore(spark, f"{tmp_path}/kv", create_if_missing=True, read_only=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit(spark.createDataFrame([(f"k{i:03d}", str(i)) for i in range(400)], "key string, value string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store.apply(spark.createDataFrame([("k005", 0, 0, None), ("a", 1, 1, "first"), ("zz", 1, 2, "last"), ("k250", 1, 3, "new")], OPS))
    store.apply(spark.createDataFrame([("zz", 0, 0, None), ("k005", 1, 1, "back"), ("zzz", 1, 2, "end")], OPS))
    register(spark)
    assert len(KvReader(store.path).partitions()) > 1
    got = [tuple(r) for r in spark.read.format("keyloom_kv").option("path", store.path).load().collect()]
    want = {f"k{i:03d}": str(i) for i in range(400)} | {"a": "first", "k250": "new", "k005": "back", "zzz": "end"}
    assert len(got) == len(want) and dict(got) == want == dict(map(tuple, store.read().collect()))


def test_leveldb(spark, tmp_path, engine):
    from keyloom.sources.leveldb_io import export_store, import_store

    kv = spark.createDataFrame([(f"bed|h|{i}|crop", f"c{i}") for i in range(25)], "key string, value string")
    store = engine.servers["garden"].store(spark)
    assert export_store(kv, f"{tmp_path}/ldb") == 25
    assert import_store(spark, f"{tmp_path}/ldb", store, chunk=10) == 25
    assert engine.table("beds").count() == 25
    with pytest.raises(StoreError):
        import_store(spark, f"{tmp_path}/absent", store)


def test_leveldb_bytes_that_are_no_text(spark, tmp_path, engine):
    from keyloom.sources import leveldb_io

    db = leveldb_io._open(spark, f"{tmp_path}/ldb", True)
    raw = {b"k\xff": b"\x00\xfe", b"k\xfe": b"plain", "é".encode(): "ü".encode()}
    for k, v in raw.items():
        db.put(bytearray(k), bytearray(v))
    db.close()
    store = engine.servers["garden"].store(spark)
    with pytest.raises(TypeConversionError, match="no UTF-8"):
        leveldb_io.import_store(spark, f"{tmp_path}/ldb", store)
    assert leveldb_io.import_store(spark, f"{tmp_path}/ldb", store, escape=True) == 3
    assert leveldb_io.export_store(store.read(), f"{tmp_path}/back", escape=True) == 3
    db = leveldb_io._open(spark, f"{tmp_path}/back", False)
    assert all(bytes(db.get(bytearray(k))) == v for k, v in raw.items())
    db.close()


def test_stream_of_operations(spark, tmp_path, engine):
    from keyloom.streaming.incremental import maintain, windowed_changes

    store = engine.servers["garden"].store(spark)
    for i, rows in enumerate(([("bed|a|1|crop", 1, 0, "x"), ("bed|a|2|crop", 1, 1, "y")], [("bed|a|1|crop", 0, 2, None)])):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
        maintain(spark.readStream.schema(OPS).parquet(f"{tmp_path}/ops"), store, f"{tmp_path}/ck").awaitTermination()
        assert engine.table("beds").count() == (2, 1)[i]
    spark.createDataFrame([("bed|a|1|crop", "2031-05-01 06:00:10"), ("bed|a|1|crop", "2031-05-01 06:00:50"), ("x", "2031-05-01 06:00:50"), ("bed|a|1|sown", "2031-05-01 06:09:00")], "key string, t string").selectExpr("key", "cast(t as timestamp) as t").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, t timestamp").parquet(f"{tmp_path}/in")
    q = windowed_changes(engine.tables["beds"].spec, stream, "t", "1 minute", "10 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got(spark.table("win").select("attr", "n")) == [("crop", 2), ("sown", 1)]


def test_typed_table_and_errors(engine):
    engine.create_table("stock", "garden", "sku TEXT NOT NULL, label TEXT, n INTEGER, price NUMERIC(8,2), fresh BOOLEAN", key_pattern="stock//{sku}//{attr}", prefix_filter="stock//")
    engine.sql("INSERT INTO stock VALUES ('s1', 'Spade', 3, 1.5, true)")
    assert [str(x) for x in engine.table("stock").first()] == ["s1", "Spade", "3", "1.50", "True"]
    assert engine.servers["garden"].store(engine.spark).get("stock//s1//fresh") == "t"
    engine.sql("INSERT INTO cells VALUES ('stock//s2//n', 'many')")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        engine.table("stock").collect()
    with pytest.raises(TypeConversionError):
        engine.sql("UPDATE stock SET label = 'x'")
    with pytest.raises(ConfigError):
        engine.sql("INSERT INTO stock (sku, nope) VALUES ('a', 'b')")
    with pytest.raises(ConfigError):
        engine.sql("UPDATE stock SET nope = 1")
    with pytest.raises(ConfigError):
        engine.create_table("stock", "garden", "id TEXT, v TEXT", key_pattern="i/{id}/{attr}")
    with pytest.raises(KvError):
        engine.import_schema("nowhere", "t")
