import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.errors import ConfigError, PatternError
from keyloom.functions import keyexpr
from keyloom.functions.pattern import KeyPattern
from keyloom.functions.types import column_type
from keyloom.plans.projection import Projection, columns

SHELF = "shelf##{room}##{row}##{attr}"


@pytest.mark.parametrize(
    "text,message",
    [
        ("", "Key pattern cannot be empty"),
        ("shelf##{room##row", "Unclosed '{' in pattern at position 7"),
        ("jar//{}//{attr}", "Empty placeholder '{}' in pattern"),
        ("q{left-hand}/{attr}", "Invalid character '-' in placeholder name 'left-hand'"),
        ("a/{attr}/{attr}", "Multiple {attr} segments in pattern"),
        ("a/{x}/{x}/{attr}", "Duplicate capture name 'x' in pattern"),
        ("a/{x}/{y}", "Pattern must contain {attr} segment"),
        ("a/{attr}{x}", "{attr} must be followed by a literal delimiter or end of pattern"),
        ("a/{x}{y}/{attr}", "Consecutive variable segments without delimiter between them"),
        ("jar//{lid//{attr}", "Invalid character '/' in placeholder name 'lid//{attr'"),
    ],
)
def test_bad_patterns(text, message):
    with pytest.raises(PatternError, match="^" + re.escape(message) + "$"):
        KeyPattern(text)


def test_lookups():
    p = KeyPattern(SHELF)
    assert p.capture_names == ("room", "row") and p.capture_count == 2
    assert p.literal_prefix == "shelf##" and p.attr_index == 5 and p.has_attr
    assert p.capture_index("row") == 1 and p.capture_index("attr") == -1 and not p.has_capture("attr")
    assert KeyPattern("a}b/{attr}").segments[0].text == "a}b/"
    assert KeyPattern("cfg/{attr}").capture_count == 0


@pytest.mark.parametrize(
    "pattern,key,want",
    [
        (SHELF, "shelf##attic##7##label", (("attic", "7"), "label")),
        ("yield={kind}~{week}/q/{attr}", "yield=leek~w31/q/kilos", (("leek", "w31"), "kilos")),
        ("{site}.{line}@{unit}.{attr}", "hill.a@u1.moist", (("hill", "a", "u1"), "moist")),
        (SHELF, "rack##attic##7##label", None),
        (SHELF, "shelf##attic##7", None),
        (SHELF, "shelf####7##label", None),
        (SHELF, "shelf##attic##7##label##de", (("attic", "7"), "label##de")),
        (SHELF, "shelf##at#tic##7-b_c##x", (("at#tic", "7-b_c"), "x")),
        ("z/{attr}/{id}", "z/x/y/w", (("y/w",), "x")),
    ],
)
def test_parse(pattern, key, want):
    assert KeyPattern(pattern).parse(key) == want


def test_build_and_prefix():
    p = KeyPattern(SHELF)
    assert p.build(["attic", "7"], "label") == "shelf##attic##7##label"
    assert p.build({"row": "7", "room": "hall"}, "label") == "shelf##hall##7##label"
    assert [p.build_prefix(v) for v in ([], ["hall"], ["hall", "7"])] == ["shelf##", "shelf##hall##", "shelf##hall##7##"]
    assert p.starts_with_prefix("shelf##x") and not p.starts_with_prefix("shel")
    assert p.leading({"row": "7"}) == [] and p.leading({"row": "7", "room": "hall"}) == ["hall", "7"]
    for values, attr, message in ((["a"], "x", "Expected 2 capture values, got 1"), (["a", "b"], "", "attr_name cannot be empty"), (["a", ""], "x", "Capture value for 'row' cannot be empty"), ({"row": "a"}, "x", "Missing capture value for 'room'")):
        with pytest.raises(PatternError, match=message):
            p.build(values, attr)


PATTERNS = [SHELF, "u#{a}#{attr}", "{a}##{attr}", "yield={a}~~{b}##p##{attr}", "{t}.{e}@{s}.{attr}", "a/{attr}/{id}", "cfg/{attr}", "x.{a}.{attr}.end", "\\E{a}\\E{attr}", "##{a}#{b}##{attr}"]


def test_expressions_agree_with_parse(spark):
    rng = random.Random(5)
    bits = ["shelf", "u", "a", "yield=", "##", "#", "~~", "@", "/", ".", "p", "x", "end", "\\E", "", "é", "\n", "cfg", "\x01"]
    keys = []
    for pattern in PATTERNS:
        p = KeyPattern(pattern)
        for _ in range(400):
            keys.append("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))))
            keys.append(p.build([rng.choice(["a", "b#", "x/y", "é", "a.b", "~~", "k\x01"]) for _ in p.capture_names], rng.choice(["n", "n##m", "é/"])))
    keys = sorted(set(keys))
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for pattern in PATTERNS:
        p = KeyPattern(pattern)
        e = keyexpr.parse(p, F.col("key"))
        got = {r["key"]: (tuple(r[f"c{i}"] for i in range(p.capture_count)), r["a"]) for r in df.where(e.valid).select("key", *(c.alias(f"c{i}") for i, c in enumerate(e.captures.values())), e.attr.alias("a")).collect()}
        assert got == {k: p.parse(k) for k in keys if p.parse(k)}, pattern


def test_types(spark):
    rows = spark.createDataFrame([("on", "\\x0aFF", "2024-01-02", "1.50")], "b string, x string, d string, n string")
    r = rows.select(column_type("bool").read(F.col("b")), column_type("bytea").read(F.col("x")), column_type("date").read(F.col("d")), column_type("NUMERIC(5,2)").read(F.col("n"))).first()
    assert r[0] is True and bytes(r[1]) == b"\x0a\xff" and str(r[2]) == "2024-01-02" and str(r[3]) == "1.50"
    back = rows.select(column_type("bool").write(F.lit(False)), column_type("bytea").write(F.unhex(F.lit("0AFF"))), column_type("timestamptz").write(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()
    assert tuple(back) == ("f", "\\x0aff", "2024-01-02 03:04:05.000000Z")
    for kind, text in (("bool", "maybe"), ("bytea", "0g"), ("int", "x")):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(text,)], "v string").select(column_type(kind).read(F.col("v"))).collect()
    with pytest.raises(ConfigError):
        column_type("uuid")
    assert column_type("timestamp with time zone").spark == "timestamp" and column_type("varchar(20)").spark == "string"


def test_projection():
    p = KeyPattern(SHELF)
    ok = Projection(p, columns('row TEXT NOT NULL, label TEXT, "room" TEXT'))
    assert [c.name for c in ok.identity] == ["room", "row"] and [c.name for c in ok.attrs] == ["label"]
    for ddl, message in (("row TEXT, label TEXT", "Pattern has 2 capture segments but projection has 1 identity columns"), ("row TEXT, room TEXT", "at least one attr column"), ("row TEXT, row TEXT, room TEXT, n TEXT", "Duplicate column name: row")):
        with pytest.raises(ConfigError, match=message):
            Projection(p, columns(ddl))
