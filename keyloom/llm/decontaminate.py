"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become sequences of words (lower case, letters and digits only). For a document and an item,
the longest match of words unmarked on both sides is found by running Karp-Rabin (all grams of the current length are
hashed on both sides and equal hashes are compared word by word; the length falls until a match appears, and matches are
extended to their end), marked, and so on down to ``MIN_MATCH`` words. Marked words never match again, so tiles do not
overlap, and passages may have been moved or interleaved. The item leaked if at least ``COVERAGE`` of its words are tiled.

Which pairs are tiled is found by a join on hashed seeds of ``MIN_MATCH`` words, and no leak is lost: tiles of m words or more
that cover ``hits`` words hold at least hits / m of the item's seeds, so a pair that shares fewer than
``COVERAGE`` * words / m of them cannot leak. Seeds that very many documents have may be left out of the join as far as an
item's other seeds still decide; the number it has to share falls by as many. Seeds of documents that no item has are
dropped where they arise, by a bit table of fixed size over the items' seeds, which may let others pass and costs no leak.

Defined cases: null text has no words; an item of fewer words than a seed needs all of its words in one piece; an item
without words never leaks; repeated rows, of documents or items, give repeated results; equal coverages are both reported;
a very long text is held by one row at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import HOT, cut, gram_hashes, keyed, texts

MIN_MATCH = 3
COVERAGE = 0.6
#: Bits of the table of the items' seeds.
BITS = 1 << 24
#: Rows that are broadcast at most, counted first; more are joined by a shuffle.
FEW = 1 << 18
#: Words whose hashes a task keeps.
KNOWN = 200_000
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(x: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the n-grams of free words."""
    if len(x) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    busy = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(busy[n:] == busy[:-n])
    return at, gram_hashes(x, n)[at]


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) of two id sequences, longest first; ids below 0 never match."""
    mine, yours = item >= 0, doc >= 0
    tiles: list[tuple[int, int, int]] = []
    n = max(least, len(item))
    while n >= least:
        a, ha = _grams(item, mine, n)
        b, hb = _grams(doc, yours, n)
        found = False
        if len(a) and len(b):
            keep = np.isin(hb, ha)
            b, hb = b[keep], hb[keep]
            order = np.argsort(ha, kind="stable")
            for y, h in zip(b.tolist(), hb.tolist(), strict=True):
                for k in range(int(np.searchsorted(ha, h, sorter=order)), len(order)):
                    x = int(a[order[k]])
                    if int(ha[order[k]]) != h:
                        break
                    if mine[x : x + n].all() and yours[y : y + n].all() and (item[x : x + n] == doc[y : y + n]).all():
                        mine[x : x + n] = False
                        yours[y : y + n] = False
                        tiles.append((x, y, n))
                        found = True
                        break
        if n == least:
            break
        free = np.concatenate([[0], mine.view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(free))
        longest = int((edge[1::2] - edge[::2]).max(initial=0))
        n = max(least, min(n - 1, longest if found else n - 1, _reach(item, doc, mine, yours, n, least)))
    return tiles


def _reach(item: np.ndarray, doc: np.ndarray, mine: np.ndarray, yours: np.ndarray, n: int, least: int) -> int:
    """The longest length below n at which a free gram is shared (``least`` if none), by halving: a shared gram of a
    length holds shared grams of every smaller one."""
    lo, hi = least, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        _, ha = _grams(item, mine, mid)
        _, hb = _grams(doc, yours, mid)
        if len(ha) and len(hb) and np.isin(hb, ha).any():
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def seeds(x: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of the n-grams of hashed words."""
    return np.unique(gram_hashes(x, n) ^ np.uint64(n)) if len(x) >= n else np.empty(0, np.uint64)


def _item_seeds(least: int, coverage: float):
    """Items -> their seeds with how often each occurs, the number of their words, and the number of seeds to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Words()
        for b in batches:
            rows = []
            for iid, text in zip(b.column("rid").to_pylist(), texts(b), strict=True):
                x = hashed.of(text)
                n = min(least, len(x))
                if n:
                    own, times = np.unique(gram_hashes(x, n) ^ np.uint64(n), return_counts=True)
                    need = max(1, math.ceil(coverage * len(x) / n - 1e-9))
                    rows += [(iid, n, need, int(s), int(t)) for s, t in zip(own.view(np.int64), times, strict=True)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["iid", "size", "need", "seed", "times"])

    return run


def _bits(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a seed in the table."""
    low = np.uint64(BITS - 1)
    return (seed & low).astype(np.int64), (seed >> np.uint64(32) & low).astype(np.int64)


def _table(items: DataFrame) -> np.ndarray:
    """The bit table of the items' seeds."""
    mask = BITS - 1
    places = F.array(F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask)))
    word = items.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out


def _document_seeds(sizes: list[int], table: np.ndarray):
    """Documents -> those of their seeds that an item may have."""

    def has(at: np.ndarray) -> np.ndarray:
        return (table[at >> 6] >> (at & 63) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Words()
        for b in batches:
            found = []
            for text in texts(b):
                x = hashed.of(text)
                own = np.concatenate([seeds(x, n) for n in sizes])
                one, two = _bits(own)
                own = own[has(one)]
                found.append(own[has(two[has(one)])] if len(own) else own)
            rid = np.repeat(np.asarray(b.column("rid"), np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(found).view(np.int64) if found else rid)], names=["rid", "seed"])

    return run


def candidates(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """``(rid, iid)`` of all pairs of ``docs(rid, text)`` and ``items(rid, text)`` that share as many seeds as a leak must."""
    own = cut(items.select("rid", "text").mapInArrow(_item_seeds(least, coverage), "iid long, size long, need long, seed long, times long"))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # 1 to the least match
    if not sizes:
        return docs.sparkSession.createDataFrame([], "rid long, iid long")
    held = cut(docs.select("rid", "text").mapInArrow(_document_seeds(sizes, _table(own)), "rid long, seed long"))
    often = held.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    hot = F.broadcast(cut(often.where(F.col("docs") * HOT > held.count())))  # fewer than HOT
    # an item does without its most common hot seeds while it has to share others
    by_item = Window.partitionBy("iid").orderBy(F.desc("docs"), "seed")
    crowded = own.join(hot, "seed").withColumn("gone", F.sum("times").over(by_item)).where("gone < need").select("iid", "seed", "gone")
    spared = crowded.groupBy("iid").agg(F.max("gone").alias("spared"))
    kept = own.join(crowded.select("iid", "seed"), ["iid", "seed"], "left_anti").join(spared, "iid", "left")
    kept = cut(kept.select("iid", "seed", "times", (F.col("need") - F.coalesce("spared", F.lit(0))).alias("need")))
    pairs = held.join(F.broadcast(kept) if kept.count() <= FEW else kept.hint("merge"), "seed")
    return pairs.groupBy("rid", "iid").agg(F.sum("times").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("rid", "iid")


def _tiled(least: int, coverage: float):
    """Candidate pairs with both texts -> those that leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, item_id, text, item in zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), texts(b), texts(b, "item"), strict=True):
                ids: dict[str, int] = {}
                x = np.array([ids.setdefault(w, len(ids)) for w in words(item)], np.int64)
                tiles = tile(x, np.array([ids.get(w, -1) for w in words(text)], np.int64), min(least, len(x)))
                hit = sum(t[2] for t in tiles)
                if hit >= coverage * len(x):
                    out.append((doc_id, item_id, len(x), hit, len(tiles), hit / len(x)))
            kinds = [pa.int64()] * 5 + [pa.float64()]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_words", "n_tiled", "n_tiles", "coverage"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_words, n_tiled, n_tiles, coverage)`` of each document and item it leaks."""
    rows = keyed(docs)
    items = keyed(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    pairs = cut(candidates(rows, items, least, coverage))
    few = pairs.count() <= FEW
    ends = F.broadcast(pairs) if few else pairs.hint("merge")
    both = rows.select("rid", "doc_id", "text").join(ends, "rid")
    both = both.join(items.select(F.col("rid").alias("iid"), F.col("doc_id").alias("item_id"), F.col("text").alias("item")), "iid")
    return both.select("doc_id", "item_id", "text", "item").mapInArrow(_tiled(least, coverage), "doc_id long, item_id long, n_words long, n_tiled long, n_tiles long, coverage double")
