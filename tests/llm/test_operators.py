"""Operators against brute force on small fixtures, and the defined odd cases."""

import hashlib
import json
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import common, decontaminate, html_main_text, lm_score, mixing, quality, queries, simhash, suffix_dedup, tool_calls, warc_fixity, winnow

SCHEMA = "doc_id long, text string"
EXTRA = SCHEMA + ", source string, part int, rid string, fp long, rest string, n int, task string, bucket int"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd(spark, docs):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "s", 1, "r", 5, "x", 2, "t", 3) for i, t in docs], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (6, "é ß " * 50), (7, "a" * 70_000), (8, " ".join(["word"] * 30_000)), (None, "no id at all"), (4, "one"), (9, "two words")]


def brute_dedup(docs, size=100):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), runs))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,hottest", [(256, 1 << 15), (3, 8), (2, 2)])
def test_suffix_dedup(spark, hot, hottest):
    rng = random.Random(hot)
    base = words(rng, 400)
    docs = [(i, base[a : a + rng.randrange(40, 400)] + rng.choice(["", "ab" * 80, "é" * 90, base[:150]]) + words(rng, 5, 10**6)) for i in range(40) for a in [rng.randrange(len(base))]]
    docs += [(100, "x" * 1000), (101, "x" * 99), (102, "x" * 100), (103, base), (104, base)]
    got = suffix_dedup.dedup(odd(spark, docs), hot=hot, hottest=hottest).collect()
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in got), key=repr) == brute_dedup(docs)


def test_suffix_dedup_odd_cases(spark):
    docs = [(d, t if t is None or len(t) < 3000 else t[:1500]) for d, t in ODD] + [(6, "é ß " * 50)]
    got = suffix_dedup.dedup(odd(spark, docs), carry=["source", "part"]).collect()
    assert sorted(((r[0], bytes(r[1]), *r[2:5]) for r in got), key=repr) == brute_dedup(docs) and {(r["source"], r["part"]) for r in got} == {("s", 1)}
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_anchors_of_a_huge_text():
    """A text of more than 2^24 bytes has the anchors its pieces have."""
    text = np.random.default_rng(2).integers(0, 256, (1 << 24) + (1 << 20), np.uint8).tobytes()
    _, start, n, offset, f = suffix_dedup.anchors([text], 100)
    for a in range(0, len(text), 1 << 22):  # a seed for which least hashes tie in 24 bits, not in 40
        piece = text[a : a + (1 << 22) + 1000]
        _, s, m, o, g = suffix_dedup.anchors([piece], 100)
        inside = (start >= a + 100) & (start + n <= a + len(piece) - 200)
        whole = set(zip((start + offset)[inside].tolist(), f[inside].tolist(), strict=True))
        assert whole <= set(zip((a + s + o).tolist(), g.tolist(), strict=True))
        spans = set(zip(start[inside].tolist(), n[inside].tolist(), (start + offset)[inside].tolist(), strict=True))
        assert spans and spans <= set(zip((a + s).tolist(), m.tolist(), (a + s + o).tolist(), strict=True))


def test_merged_transforms_are_sorted():
    """The merged order is that of all suffixes, and its intervals are the equal prefixes."""
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(11, 60)) for _ in range(12)]
    rounds, step = 4, suffix_dedup.STEP
    shards = [strings[:5], strings[5:6], strings[6:]]
    transforms, suffixes = [], []
    for shard in shards:
        lens = np.array([len(s) + step for s in shard])
        first = np.cumsum(lens) - lens
        symbol = np.concatenate([np.append(s, np.zeros(step, int)) for s in shard])
        order, before = suffix_dedup.shard_transform(symbol, first, lens, rounds)
        transforms.append(before)
        for o in order:
            k = int(np.searchsorted(first, o, "right")) - 1
            at = int(o - first[k])
            s = [*shard[k], *([0] * step)]
            key = []
            while len(key) < rounds:
                key.append(int(s[at]) if at < len(s) else 0)
                if key[-1] == 0:
                    key += [0] * (rounds - len(key))
                at += step
            suffixes.append(tuple(key))
    row, group = suffix_dedup.merge_transforms(transforms, rounds)
    merged = [suffixes[i] for i in row]
    assert merged == sorted(suffixes)
    whole = [all(k) for k in merged]
    for i in range(1, len(merged)):
        if whole[i] and whole[i - 1]:
            assert (group[i] == group[i - 1]) == (merged[i] == merged[i - 1])


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(range(len(fps)))

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                ids[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rng = random.Random(4)
    docs = [(i, t) for i, t in ODD if len(t or "") < 1000]
    for i in range(60):
        w = words(rng, 150, 500).split()
        docs.append((10 + 3 * i, " ".join(w)))
        for k in range(2):
            w[rng.randrange(150)] = "Changed"
            docs.append((11 + 3 * i + k, " ".join(w)))
    got = simhash.near_duplicates(odd(spark, docs)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    root = brute_components(fps)
    least = {r: min((d for (d, _), x in zip(docs, root, strict=True) if x == r and d is not None), default=None) for r in root}
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, root, strict=True))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_lose_nothing(spark):
    """Chains of fingerprints three bits apart, in every place of the 64 bits."""
    rng = random.Random(9)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.append(x)
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {r["node"]: r["root"] for r in common.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    root = brute_components(fps)
    groups = lambda keys: {frozenset(signed[i] for i in range(len(fps)) if keys[i] == k) for k in set(keys)}
    assert groups([found.get(f, f) for f in signed]) == groups(root)


def test_components_on_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_winnow(spark):
    rng = random.Random(2)
    docs = [(i * 3, words(rng, rng.randrange(0, 90))) for i in range(120)] + [(500, None), (501, ""), (502, "short"), (503, "é" * 50), (504, words(rng, 20_000))]
    got = {r["doc_id"]: r for r in winnow.compared(odd(spark, docs)).collect()}
    order = sorted(docs, reverse=True, key=lambda x: x[0])
    assert len(got) == len(docs)
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        sets = [set(winnow.winnow(winnow.codes(x))[1].tolist()) for x in (t, e, n)]
        j = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(j(sets[0], sets[1])) and r["near_next"] == pytest.approx(j(sets[0], sets[2]))
        assert t != e or r["fingerprint"] == r["edited_fingerprint"]
    one = winnow.compared(spark.createDataFrame([(1, "alone")], SCHEMA)).first()
    assert one["near_next"] == 1.0 and winnow.compared(empty(spark)).count() == 0
    assert winnow.compared(odd(spark, ODD)).count() == len(ODD)


def test_winnow_of_ids_that_repeat(spark):
    """Rows of one id, or of none, follow each other in the falling order of their texts; fingerprints are the brute-force choice."""
    rng = random.Random(7)
    docs = [(rng.choice([None, 3, 3, i]), rng.choice([words(rng, 30), "same text of some rows", None])) for i in range(90)]
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""), reverse=True)
    want = []
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        prints = []
        for x in (t, e):
            grams = common.gram_hashes(winnow.codes(x), min(winnow.K, len(x))) >> np.uint64(32) if x else []
            size = min(winnow.WINDOW, len(grams))
            at = sorted({i + max(j for j in range(size) if grams[i + j] == min(grams[i : i + size])) for i in range(len(grams) - size + 1)}) if len(grams) else []
            prints.append("".join(f"{int(grams[p]):08x}{p - q:02x}" for p, q in zip(at, [0, *at], strict=False)))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *prints))
    got = [tuple(r)[:5] for r in winnow.compared(odd(spark, docs)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_winnow_guarantee_and_ties():
    rng = random.Random(6)
    a, b = words(rng, 200), words(rng, 200)
    shared = words(rng, 12)[: winnow.K + winnow.WINDOW - 1]
    x, y = (winnow.winnow(winnow.codes(t)) for t in (a + shared + b[:50], b + shared + a[:50]))
    assert set(x[1].tolist()) & set(y[1].tolist())
    at, h = winnow.winnow(winnow.codes("z" * 200))
    assert len(at) == 200 - winnow.K - winnow.WINDOW + 2 and at[0] == winnow.WINDOW - 1 and len(set(h.tolist())) == 1  # rightmost of ties
    text = words(rng, 300)
    at, h = winnow.winnow(winnow.codes(text))
    every = common.gram_hashes(winnow.codes(text), winnow.K)
    want = set()
    for i in range(len(every) - winnow.WINDOW + 1):
        w = every[i : i + winnow.WINDOW] >> np.uint64(32)
        want.add(i + max(k for k in range(winnow.WINDOW) if w[k] == w.min()))
    assert at.tolist() == sorted(want)
    rows = [[hash(g) for g in (text[i : i + 5],)] for i in range(5)]
    assert rows and winnow.likeness(np.array([1, 2]), np.array([2, 3])) == pytest.approx(1 / 3)


def brute_tiles(item, doc, least):
    """Greedy string tiling by comparing everything."""
    mine, yours, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = []
        longest = least - 1
        for x in range(len(item)):
            for y in range(len(doc)):
                n = 0
                while x + n < len(item) and y + n < len(doc) and mine[x + n] and yours[y + n] and item[x + n] == doc[y + n] >= 0:
                    n += 1
                if n > longest:
                    best, longest = [(x, y)], n
                elif n == longest >= least:
                    best.append((x, y))
        if not best:
            return total
        for x, y in best:
            if all(mine[x : x + longest]) and all(yours[y : y + longest]):
                mine[x : x + longest] = [False] * longest
                yours[y : y + longest] = [False] * longest
                total += longest


def test_greedy_tiling():
    rng = random.Random(8)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(3, 25))])
        doc = np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(0, 40))], np.int64)
        tiles = decontaminate.tile(item, doc, 3)
        for x, y, n in tiles:
            assert (item[x : x + n] == doc[y : y + n]).all() and n >= 3
        spots = [i for x, _, n in tiles for i in range(x, x + n)]
        assert len(spots) == len(set(spots))
        assert len(spots) == brute_tiles(item.tolist(), doc.tolist(), 3)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 40, 10**5)) for i in range(6)] + [(90, "two words"), (91, None), (92, "")]
    w = [t.split() for _, t in items[:6]]
    docs = [(1, words(rng, 50) + " " + items[0][1].upper() + "! " + words(rng, 30)), (2, " ".join(w[1][20:] + words(rng, 9).split() + w[1][:20])), (3, " ".join(w[2][:12])), (4, words(rng, 500)), (5, "just two words here"), (6, None), (7, ""), (1, "repeat " + items[3][1])]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (2, 1), (5, 90), (1, 3)}
    assert decontaminate.leaks(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(odd(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_are_those_of_exhaustive_tiling(spark, monkeypatch):
    """Items in pieces of three to five words in any order, among phrases that many documents and items share."""
    rng = random.Random(12)
    common = [words(rng, 4, 10**6) for _ in range(3)]
    items = [(i, words(rng, rng.randrange(4, 30), 25 if i % 3 else 10**5) + " " + common[i % 3]) for i in range(25)] + [(None, words(rng, 8)), (3, "one two three"), (3, "one two three"), (77, "short")]
    docs = []
    for i in range(80):
        w = items[rng.randrange(len(items))][1].split()
        size = rng.choice([3, 4, 5])
        pieces = [w[k : k + size] for k in range(0, len(w), size) if rng.random() < 0.8]
        rng.shuffle(pieces)
        docs.append((rng.choice([i, i, 5, None]), " , ".join(" ".join(p) + " " + rng.choice(["x", "Y z", common[i % 3]]) for p in pieces)))
    docs += [(900, " ".join([items[4][1]] * 400)), (901, None)]
    ids = {}
    coded = lambda t: [ids.setdefault(w, len(ids)) for w in decontaminate.words(t or "")]
    want = []
    for d, t in docs:
        for k, item in items:
            x, y = coded(item), coded(t)
            hit = brute_tiles(x, y, min(3, len(x))) if len(y) < 500 else sum(n for _, _, n in decontaminate.tile(np.array(x), np.array(y), min(3, len(x))))
            if hit >= 0.6 * len(x):
                want.append((d, k, len(x), hit))
    bench = spark.createDataFrame([(k, t, "r", 1, "s", 2) for k, t in items], "item_id long, text string, rid string, doc_id int, seed string, n int")
    for hot, few in ((decontaminate.HOT, decontaminate.FEW), (8, 0)):
        monkeypatch.setattr(decontaminate, "HOT", hot)
        monkeypatch.setattr(decontaminate, "FEW", few)
        got = decontaminate.leaks(odd(spark, docs), bench).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["item_id"], r["n_words"], r["n_tiled"])) for r in got) and len(want) > 40


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>One</a></li></ul></nav><div class="ad">Buy</div><div id='cookie-notice'>Accept</div>
<article><h1>Head &lt;1&gt;</h1><p><b>First &eacute;  para<br>graph<br><p>Second <i>one</i> &amp;amp; more<form>Mail</form><p>Third<section class="comments"><p>Nice!</section><!-- <p>no</p> --></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    assert html_main_text.main_text(html_main_text.blocks(PAGE), None)[0] == "Head <1>\nFirst é para graph\nSecond one &amp; more\nThird"
    plain = "<body><div>Menu A</div><p>Text {}</p><div>Imprint</div></body>"
    rows = [(1, "http://h.org/a/1", PAGE), (2, "http://h.org/b/1", None), (3, None, ""), (4, "http://p.org/x/1", plain.format(1)), (5, "https://p.org/x/2?q=1", plain.format(2)), (6, "http://p.org/x/9#t", plain.format(3)), (1, "http://h.org/a/1", PAGE), (7, "bad url", "<p>Lone <b>text"), (8, "http://big.org/", "<p>x</p>" * 3000), (9, "http://big.org/2", "<p>y</p><p>x</p>" * 1500)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, line int")
    got = sorted((r["page_id"], r["text"]) for r in html_main_text.extract(pages).collect())
    assert [g for g in got if g[0] < 8] == sorted([(1, "Head <1>\nFirst é para graph\nSecond one &amp; more\nThird")] * 2 + [(2, ""), (3, ""), (4, "Text 1"), (5, "Text 2"), (6, "Text 3"), (7, "Lone text")])
    assert len(dict(got)[9]) and html_main_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><div class="entry-header"><h1>Title</h1></div><p class="search-term">Found</p></article>', "Title\nFound"),
        ('<article><p id=comments>Kept</p><div class="reader-comments"><p>Nice</p></div><ul class="x related-list"><li>More</ul><p>End</article>', "Kept\nEnd"),
        ("<article><p>A <img alt=it's> b<p>C <a title='x > y' href=q\"z>d</a></article>", "A b\nC d"),
        ("<article><p>Whole<img alt='never closed", "Whole"),
        ("<article><p>Whole<!-- never closed <p>x", "Whole"),
        ("<div class='page-header'>Off</div><main><header class=banner><h2>In</h2></header><p>Text", "Text"),
        (f"<article><p {'a=b ' * 20000}>Long</p></article>", "Long"),
        ("<p>" + "w " * 50000, ("w " * 50000).strip()),
        ("<div>" * 3000 + "deep", "deep"),
        (None, ""),
    ],
)
def test_odd_markup(page, text):
    assert html_main_text.main_text(html_main_text.blocks(page or ""), None)[0] == text


def test_differencing_of_pages_without_article_markup(spark):
    """Menus, notices and imprints in plain elements without names: precision and recall of lines against the planted text."""
    rng = random.Random(9)
    pages, want = [], {}
    for host in range(6):
        menu, foot = [words(rng, 3, 10**5) for _ in range(5)], words(rng, 12, 10**5)
        for i in range(25):
            body = [words(rng, rng.randrange(8, 40), 10**5) for _ in range(rng.randrange(1, 6))]
            own = words(rng, 4, 10**5) if rng.random() < 0.1 else menu[0]  # now and then a menu entry of the page's own
            lines = [f"<div>{m}</div>" for m in [own, *menu[1:]]] + [f"<p>{x}</p>" for x in body] + [f"<div>{foot}</div>"]
            pages.append((len(pages), f"http://h{host}/a/{i:03d}", "<body>" + "".join(lines)))
            want[len(pages) - 1] = body
    got = {r["page_id"]: r["text"].split("\n") for r in html_main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hit = sum(len(set(got[k]) & set(want[k])) for k in want)
    assert hit / sum(map(len, want.values())) == 1.0 and hit / sum(map(len, got.values())) > 0.9


def test_pairs_across_partitions(spark):
    """Each page is paired as if all were in one partition, however they are dealt."""
    line = lambda i: f"<body><div>Menu {i // 4}</div><p>Text {i}</p><div>Menu {(i + 1) // 4}</div></body>"
    rows = [(i, f"http://h{i // 30}.org/a/{i:04d}", line(i)) for i in range(180)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 5 * html_main_text.GROUP)  # edges of several groups
    try:
        got = {r["page_id"]: r["text"] for r in html_main_text.extract(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    read = [html_main_text.blocks(h) for _, _, h in rows]
    for i in range(180):
        pair = i - 1 if i % 30 else i + 1
        assert got[i] == html_main_text.main_text(read[i], read[pair])[0]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for limit in (1 << 20, 4):
        html_main_text.TABLE = limit
        for _ in range(40):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            kept = [x for x, s in zip(a, html_main_text.shared(a, b), strict=True) if s]
            it = iter(b)
            assert len(kept) == best[-1][-1] and all(x in it for x in kept)
    html_main_text.TABLE = 1 << 20


def test_quality(spark):
    rng = random.Random(0)
    good = lambda: ". ".join(words(rng, 12, 5000).capitalize() for _ in range(6)) + "."
    bad = lambda: rng.choice([" ".join(["spam"] * 60), words(rng, 50).upper().replace(" ", "!! "), words(rng, 40).replace(" ", " | ")])
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(400)]
    docs = odd(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, None, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r["held_out"])
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert quality.scored(odd(spark, ODD), model).count() == len(ODD)
    assert quality.scored(empty(spark), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    kept = {r["doc_id"] for r in quality.kept(docs, model).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_quality_of_held_out_rows(spark):
    """Held-out ranking and accuracy on the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    high, low = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in high for b in low]) > 0.98 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_tree_arrays_walk_like_single_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.STATS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = quality.grow(x, y, trees=20)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97

    def walk(row, node):
        while m.stat[node] >= 0:
            node = m.left[node] + (row[m.stat[node]] > m.cut[node])
        return m.value[node]

    assert np.allclose(m.margin(x[:50]), [m.base + sum(walk(r, k) for k in m.roots) for r in x[:50]])


def test_pseudo_likelihood(spark):
    rng = random.Random(5)
    pairs = [("red", "rose"), ("blue", "sky"), ("green", "leaf"), ("black", "coal")]
    text = lambda: " ".join(f"{a} {b} ." for a, b in (rng.choice(pairs) for _ in range(60)))
    docs = [(i, text()) for i in range(300)]
    mixed = docs[0][1].split()
    rng.shuffle(mixed)
    docs += [(1000, " ".join(mixed))]
    got = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(odd(spark, docs)).collect()}
    assert got[0]["n_tokens"] == 180 and got[1000]["mean_log_prob"] < got[0]["mean_log_prob"] - 0.3
    flat = lm_score.pseudo_likelihood(odd(spark, docs), rounds=0).where("doc_id = 0").first()
    assert got[0]["log_likelihood"] > flat["log_likelihood"]
    odd_ones = lm_score.pseudo_likelihood(odd(spark, ODD)).collect()
    assert len(odd_ones) == len(ODD) and [tuple(r)[1:] for r in odd_ones if r["doc_id"] == 2] == [(0, 0.0, None)]
    assert lm_score.pseudo_likelihood(empty(spark)).count() == 0


def test_network_probabilities_and_gradient():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, lm_score.VOCAB).astype(float)
    net = lm_score.Network.fresh(counts)
    context = rng.integers(0, lm_score.VOCAB + 1, (len(lm_score.PLACES), 1))
    p = np.exp(net.log_prob(np.repeat(context, lm_score.VOCAB, axis=1), np.arange(lm_score.VOCAB)))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    ids = rng.integers(0, lm_score.VOCAB, 30)
    padded, places = lm_score._padded([ids[:10], ids[10:]])
    assert lm_score.document_scores([ids[:10], ids[10:]], net) == pytest.approx([lm_score.document_scores([x], net)[0] for x in (ids[:10], ids[10:])], rel=1e-5)
    seen = lm_score.Network(np.full(lm_score.Network.size(), 1e-8, np.float32))
    c = lm_score.windows(padded, places)
    before = net.log_prob(c, padded[places]).sum()
    for _ in range(5):
        net.learn(c, padded[places], seen)
    assert net.log_prob(c, padded[places]).sum() > before


def brute_score(text, net, vocab, n):
    """The sum of log P(word | two words on either side), one word at a time in plain loops."""
    known = lm_score.tokens(text or "")
    ids = [int(vocab.ids[vocab[w]]) for w in known]
    total = 0.0
    for i, w in enumerate(known):
        h = net.lift.astype(float).copy()
        for j, d in enumerate(lm_score.PLACES):
            h += net.embed[j][ids[i + d] if 0 <= i + d < len(ids) else net.vocab]
        h = np.tanh(h)
        cls, member = ids[i] % net.classes, ids[i] // net.classes
        for logits, at in ((h @ net.cw + net.cb, cls), (h @ net.ww[cls] + net.wb[cls], member)):
            total += logits[at] - np.log(np.exp(logits).sum())
        single = vocab.size - vocab.buckets
        if ids[i] >= single:  # a word's share of the words that have its id
            total += np.log(n[w]) - np.log(sum(c for x, c in n.items() if int(vocab.ids[vocab[x]]) == ids[i]))
    return total


def test_scores_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCAB", 36)
    monkeypatch.setattr(lm_score, "OOV", 9)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(90, None), (91, "")]
    df = odd(spark, docs)
    n = Counter(w for _, t in docs for w in lm_score.tokens(t or ""))
    for known in (5, 200_000):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        vocab, of_ids, counts = lm_score.vocabulary(df)
        coded = lm_score.encoded(df, vocab)
        net = lm_score.train(coded, of_ids)
        got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.scored(coded, counts, net).collect()}
        assert got == pytest.approx({i: brute_score(t, net, vocab, n) for i, t in docs}, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_word_is_a_target(spark, monkeypatch, rounds):
    docs = [np.arange(10, 10 + n) + 100 * n for n in (1, 2, 3, 7, 40)]
    seen = Counter()
    monkeypatch.setattr(lm_score.Network, "learn", lambda self, context, word, seen_: seen.update(word.tolist()))
    batch = lambda: lm_score.pa.RecordBatch.from_pydict({"ids": [d.astype(np.uint16).tobytes() for d in docs], "task": [0] * len(docs)})
    monkeypatch.setattr(lm_score, "_trained", lambda rows, net, turn, stride: [list(lm_score._train(net.vocab, net.flat, turn, stride)(iter([batch()]))), net][1])
    lm_score.train(None, np.ones(lm_score.VOCAB), rounds)
    assert set(seen) == set(np.concatenate(docs).tolist())


def test_rare_words_share_an_id_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCAB", 16)
    monkeypatch.setattr(lm_score, "OOV", 4)
    docs = [(i, " ".join(f"common{k}" for k in range(60) for _ in range(3))) for i in range(60)]
    shares = {}
    for i in range(2000):
        shares.setdefault(zlib.crc32(f"rare{i}".encode()), f"rare{i}")
    rare = list(shares.values())
    docs += [(1000 + i, w) for i, w in enumerate(rare)] + [(5000 + i, rare[0]) for i in range(6)] + [(6000, "y" * 300), (6001, "y" * 300)]
    df = odd(spark, docs)
    vocab, of_ids, counts = lm_score.vocabulary(df)
    n = sum(len(t.split()) for _, t in docs)
    assert vocab.size == len(of_ids) and of_ids.sum() == n == counts.agg(F.sum("n")).first()[0]
    assert vocab.size - vocab.buckets == int(n**0.5) // 2 > lm_score.VOCAB  # the words with ids grow with the corpus
    scores = []
    for known in (0, 200_000):  # counts joined, counts in the task
        monkeypatch.setattr(lm_score, "KNOWN", known)
        scores.append({r["doc_id"]: r["log_likelihood"] for r in lm_score.pseudo_likelihood(df, rounds=1).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)
    twin = next(i for i in range(1, len(rare)) if zlib.crc32(rare[i].encode()) % vocab.buckets == zlib.crc32(rare[0].encode()) % vocab.buckets)
    assert scores[0][1000] - scores[0][1000 + twin] == pytest.approx(np.log(7), rel=1e-6)


def test_pfair_schedule():
    blocks, weights = {"a": 40, "b": 17, None: 9, "c": 1}, {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05}
    rows = list(mixing.schedule(blocks, weights))
    assert [r[0] for r in rows] == list(range(67)) and Counter(r[1] for r in rows) == blocks
    assert all(release <= slot < due for slot, _, _, release, due in rows)
    left, t0, given = dict(blocks), 0, Counter()
    for slot, s, _, _, _ in rows:
        share = mixing.shares({x: weights[x] for x in left}, mixing.PERIOD)
        given[s] += 1
        left[s] -= 1
        assert all(abs(given[x] - (slot + 1 - t0) * share[x] / mixing.PERIOD) < 1 for x in left)
        if not left[s]:
            del left[s]
            t0, given = slot + 1, Counter()


def brute_schedule(blocks, weights, period):
    """Slot by slot: of all released blocks the one with the earliest deadline."""
    left, done, slot = {s: n for s, n in blocks.items() if n}, Counter(), 0
    while left:
        share = mixing.shares({s: weights[s] for s in left}, max(period, len(left)))
        total, start, had = max(period, len(left)), slot, Counter()
        assert sum(share.values()) == total
        while all(left.values()):
            free = [(-(-(had[s] + 1) * total // share[s]), -share[s], s is not None, s or "", s) for s in left if had[s] * total // share[s] <= slot - start]
            s = min(free)[-1]
            yield slot, s, done[s], start + had[s] * total // share[s], start - (-(had[s] + 1) * total // share[s])
            had[s], done[s], left[s], slot = had[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}


def test_schedule_is_that_of_slot_by_slot_selection():
    rng = random.Random(1)
    for _ in range(150):
        period = rng.choice([1, 5, 16, 64, 1000])
        blocks = {None if i == 0 else f"s{i}": rng.randrange(0, 60) for i in range(rng.randrange(1, 7))}
        weights = {s: rng.choice([1, 1, 0.01, 5, rng.random() + 0.01]) for s in blocks}
        assert list(mixing.schedule(blocks, weights, period)) == list(brute_schedule(blocks, weights, period))


def test_shares_are_close_to_weights():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2, "tiny": 1e-9}
    share = mixing.shares(weights, mixing.PERIOD)
    assert sum(share.values()) == mixing.PERIOD and all(abs(q / mixing.PERIOD - weights[s]) < 2 / mixing.PERIOD for s, q in share.items()) and share["tiny"] == 1
    assert sum(mixing.shares({str(i): 1.0 for i in range(100)}, 100).values()) == 100


@pytest.mark.parametrize("period", [7, 1 << 17])
def test_rows_stand_where_the_schedule_says(spark, period):
    """Weights that tie, sources that run out after many periods, ids that are null or repeat."""
    rows = [(i if i % 5 else None, ["a", "b", None, "a", "c"][i % 5], "t" * (i % 3)) for i in range(600)] + [(1, "a", "t")] * 3
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, source string, text string, j int, size int")
    weights = {"a": 1.0, "b": 1.0, None: 2.0, "c": 1.0}
    got = mixing.mixed(docs, weights, block_rows=4, period=period).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows))) and Counter((r["doc_id"], r["source"]) for r in got) == Counter(r[:2] for r in rows)
    sizes = Counter(r[1] for r in rows)
    want = list(brute_schedule({s: -(-n // 4) for s, n in sizes.items()}, weights, period))
    assert {(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in got} == set(want)
    assert [r["slot"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["slot"] for r in got)


def test_mixing(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(700)] + [(None, "hot"), (5, None), (5, None), (5, "hot")]
    docs = spark.createDataFrame([(i, s, 0, 0) for i, s in rows], "doc_id long, source string, block int, n int")
    got = mixing.mixed(docs, {"hot": 2.0}, block_rows=8).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"hot": 0})


def test_merkle_audit(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 50) + "p" * (i * 7 % 900)) for i in range(3000)] + [(None, None, None), (7, "http://x/7", "again")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    recs = warc_fixity.records(pages)
    assert warc_fixity.audit(recs, recs).count() == 0
    hurt = recs.withColumn("digest", F.when(F.col("page_id").isin(3, 2500), F.lit(b"?")).otherwise(F.col("digest"))).where("page_id is null or page_id <> 1024")
    got = {(r["page_id"], r["kind"]) for r in warc_fixity.audit(recs, hurt).collect()}
    assert got == {(3, "corrupt"), (2500, "corrupt"), (1024, "missing")}
    assert {r["kind"] for r in warc_fixity.audit(hurt, recs).collect()} == {"corrupt", "extra"}
    assert warc_fixity.audit(recs, recs.limit(0)).count() == len(rows)
    whole = b"".join(bytes(r[0]) for r in pages.where("page_id < 5").select(warc_fixity.record(F.col("page_id"), F.col("url"), F.col("html"))).collect())
    assert [b.decode() for _, b in warc_fixity.parse(whole)] == [t for _, _, t in rows[:5]]
    at = recs.where("page_id < 1024").orderBy("offset").collect()
    assert at[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(at, at[1:], strict=False))


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, "a", "t", '{"x": 1}', None, 0), (1, "b", "t", '{"x": "no"}', "a", 2), (1, "c", "t", "[1]", "b", 4), (1, "d", "u", "{}", "e", 5), (1, "e", "t", '{"x": NaN}', "d", 6), (2, "a", "t", None, "gone", 0), (None, "a", "t", '{"y": 2, "x": 3}', "a2", 1), (None, "a2", "t", '{"x": 3}', None, 0)], "conv_id long, call_id string, tool string, arguments string, after string, place long")
    results = spark.createDataFrame([(1, "a", "late", 9), (1, "a", "ok", 1), (1, "z", "lost", 3), (None, "a", "é\n", 2)], "conv_id long, call_id string, content string, place long")
    schema = {"t": {"required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}}}
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.linked(calls, results, schema).collect()}
    assert {k: (r["level"], r["status"], r["valid"]) for k, r in got.items()} == {(1, "a"): (0, "linked", True), (1, "b"): (1, "unanswered", False), (1, "c"): (2, "unanswered", False), (1, "d"): (None, "unanswered", False), (1, "e"): (None, "unanswered", False), (2, "a"): (0, "unanswered", False), (None, "a"): (1, "linked", True), (None, "a2"): (0, "unanswered", True), (1, "z"): (None, "orphan", None)}
    assert got[None, "a"]["json"] == '{"after":"a2","arguments":{"x":3,"y":2},"conversation":null,"id":"a","level":1,"result":"é\\n","status":"linked","tool":"t"}'
    assert '"result":"ok"' in got[1, "a"]["json"] and got[1, "d"]["problems"] == "unknown tool" and got[1, "e"]["problems"] == "not JSON"
    chain = spark.createDataFrame([(1, str(i), "t", '{"x":1}', str(i - 1), i) for i in range(200)], calls.schema)
    assert sorted(r["level"] for r in tool_calls.levels(chain).collect()) == list(range(200))
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", ""), (1, 1, "assistant", "yo"), (2, 0, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert tool_calls.linked(*tool_calls.turns(talk)).count() == 4
    assert tool_calls.linked(*tool_calls.turns(talk.limit(0))).count() == 0


def test_every_result_has_a_row(spark, tmp_path):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 5, "assistant", "x"), (2, 5, "assistant", "y"), (None, 1, "tool", None), (None, 1, "tool", None)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter((r["conv_id"], r["status"], json.loads(r["json"])["result"]) for r in queries.op9_tool_calls(spark, str(tmp_path)).collect())
    assert got == Counter([(1, "linked", "a"), (1, "duplicate", "a"), (1, "duplicate", "b"), (2, "orphan", "x"), (2, "orphan", "y"), (None, "orphan", None), (None, "orphan", None)])


def test_row_keys(spark):
    rows = [(3, "b"), (3, "a"), (None, "x"), (1, None), (3, "a")]
    got = [tuple(r) for r in common.keyed(spark.createDataFrame(rows, SCHEMA)).orderBy("rid").select("rid", "doc_id", "text").collect()]
    assert got == [(0, None, "x"), (1, 1, None), (2, 3, "a"), (3, 3, "a"), (4, 3, "b")]
