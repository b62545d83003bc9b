"""The pipeline on a small corpus with planted cases, stage by stage against brute force."""

import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline as p
from keyloom.llm import near_copies, quality
from tests.llm.test_operators import brute_dedup, words

COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    bench = [(i, words(rng, 40, 10**6)) for i in range(3)]
    passage = words(rng, 60, 10**6)
    clean = lambda n=120: ". ".join(words(rng, 10, 10**5).capitalize() for _ in range(n // 10)) + "."
    docs = {i: clean() for i in range(200)}
    docs |= {200 + i: " ".join(["spam"] * 80) + words(rng, 3) for i in range(40)}
    docs[300] = docs[10]
    docs[301] = docs[11] + " Tail"
    docs[302], docs[303] = clean() + "\n" + passage, clean() + "\n" + passage
    docs[304] = clean() + "\n" + " ".join(bench[1][1].split()[20:] + ["between"] + bench[1][1].split()[:20])
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, COLS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 240), 0) for i in docs if i < 240], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, passage


def brute_near_copies(docs):
    """The least id of each component of documents whose five-word shingles are 0.8 alike."""
    split = {i: t.encode().lower().split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    at = {i: i for i in docs}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in docs:
        for j in docs:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return {find(i) for i in docs}


def test_stages(spark, corpus, tmp_path):
    d, docs, passage = corpus
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in df.collect()}
        stage(spark, df, d).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == [c.split()[0] for c in COLS.split(", ")]
        after = {r["doc_id"]: r["text"] for r in df.collect()}
        if name == "quality":
            assert set(before) - set(after) == set(range(200, 240)) and all(before[i] == t for i, t in after.items())
        elif name == "near_dedup":
            assert set(after) == brute_near_copies(before) and {300, 301} <= set(before) - set(after)
        elif name == "passage_dedup":
            want = {i: kept.decode("utf-8", "ignore") for i, kept, n, gone, _ in brute_dedup(list(before.items())) if kept or not gone}
            assert after == want and passage in after[302] and passage not in after[303]
            assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
        else:
            assert set(before) - set(after) == {304}
    mixed = p.STAGES[-1][1](spark, df, d)
    assert sorted(r["position"] for r in mixed.collect()) == list(range(df.count()))
    assert {tuple(r) for r in p.run(spark, d).collect()} == {tuple(r) for r in mixed.collect()}


def test_odd_rows(spark, corpus):
    """Nulls, empty, long and repeated rows, and columns whose names clash: what each stage keeps."""
    d, docs, _ = corpus
    long = "x" * 50_000 + " " + docs[3] * 40
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text here", None, None, 5), (None, "some text here", "en", "s", 5), (3, long, "en", "s", 1), (4, "a b c", "en", None, 5), (4, "a b d", "en", None, 5), (5, long, "de", "t", 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], COLS + ", part string")
    said = lambda x: sorted(map(str, x))
    kept = {name: [tuple(r) for r in stage(spark, df, d).collect()] for name, stage in p.STAGES}
    model = quality.fit(df, spark.read.parquet(f"{d}/labels.parquet"))
    good = {t for _, t, *_ in rows if model.score(np.array([quality.statistics(t or "")]))[0] >= quality.THRESHOLD}
    assert said(kept["quality"]) == said((*r, "extra") for r in rows if r[1] in good)
    assert said((r[0], r[1]) for r in kept["near_dedup"]) == said([(1, None), (None, "some text here"), (3, long), (4, "a b c"), (4, "a b d")])
    cut = {(i, k.decode("utf-8", "ignore")) for i, k, _, gone, _ in brute_dedup([r[:2] for r in rows]) if k or not gone}
    assert {(r[0], r[1] or "") for r in kept["passage_dedup"]} == cut and len(kept["passage_dedup"]) == len(rows) - 1  # nothing is left of the second long one
    assert said(kept["benchmark"]) == said((*r, "extra") for r in rows)
    mixed = p.mix(spark, df, d).collect()
    assert sorted(r["position"] for r in mixed) == list(range(len(rows))) and said((r["doc_id"], r["source"]) for r in mixed) == said((r[0], r[3]) for r in rows)
    for _, stage in p.STAGES:
        assert stage(spark, df.limit(0), d).count() == 0


def test_rows_with_odd_ids(spark, corpus):
    d, docs, _ = corpus
    leak = docs[304]
    rows = [(None, docs[1]), (5, docs[1]), (None, docs[2]), (7, docs[3]), (7, docs[4]), (None, leak), (8, leak + " more"), (8, docs[5])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLS)
    texts = lambda stage: sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, df, d).collect())
    assert texts(p.near_dedup) == sorted([(0, docs[1]), (0, docs[2]), (7, docs[3]), (7, docs[4]), (0, leak), (8, docs[5])])
    assert texts(p.benchmark_filter) == sorted((i or 0, t) for i, t in rows if not t.startswith(leak))


def test_near_copies_of_edited_words(spark, monkeypatch):
    rng = random.Random(3)
    docs = {}
    for i in range(60):
        w = words(rng, 90, 10**5).split()
        docs[100 * i] = " ".join(w)
        for k in range(1, 5):  # one to four edits, apart from each other and near the ends
            v = list(docs[100 * i + k - 1].split())
            v[rng.randrange(90)] = f"edit{k}"
            docs[100 * i + k] = " ".join(v)
    docs |= {9000 + i: docs[0] for i in range(3)} | {9100: "", 9101: "  "}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], COLS)
    want = brute_near_copies(docs)
    for few in (near_copies.FEW, 0):
        monkeypatch.setattr(near_copies, "FEW", few)
        assert {r["doc_id"] for r in p.near_dedup(spark, df, "").collect()} == want and len(want) < 70


def test_prefixes_find_all_near_copies(spark):
    """The exact join finds every pair of other components, also among edited copies of one text and shared passages."""
    rng = random.Random(6)
    base, passage = words(rng, 120, 10**5).split(), words(rng, 40, 10**5)
    docs = []
    for i in range(160):
        v = list(base)
        for _ in range(rng.randrange(0, 7)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(12)}"
        docs.append((i, i, " ".join(v[rng.randrange(0, 9) :]) if i % 2 else passage + " " + words(rng, rng.randrange(5, 80), 10**5)))
    sets = [near_copies.shingles(t) for *_, t in docs]
    near = {(i, j) for i in range(160) for j in range(i + 1, 160) if near_copies.jaccard(sets[i], sets[j]) >= 0.8}
    found = {tuple(r) for r in near_copies.cross_pairs(spark.createDataFrame(docs, "rid long, root long, text string")).collect()}
    assert near and near <= found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_sql_of_operators(spark):
    from keyloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):  # what the SQL reads
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(map(str, map(tuple, got.select(*(f"`{c}`" for c in cols)).collect()))) == sorted(map(str, rel.fetchall())), name
