"""Document fingerprints by winnowing.

Every ``K``-gram of code points has a rolling 64-bit hash; of each ``WINDOW`` consecutive hashes the least is chosen, the
rightmost of equal ones, and kept with its position. Any common substring of ``WINDOW + K - 1`` code points therefore
shares a chosen hash. A text with fewer grams than a window is one window; one shorter than a gram is one gram.

Two fingerprints are compared by the Jaccard likeness of their hash sets (1 for two empty ones).

Defined cases: null text is empty and has the empty fingerprint; the next document is the one of the next smaller id
(after the smallest, the largest), a null id counting as smaller than any and rows of one id following each other in
the falling order of their texts, null last; a single document is its own next one; an empty table gives an empty result; extra columns
are ignored. A text is held by one row at a time, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import gram_hashes, keyed, parts_of, sliding_min

K = 10
WINDOW = 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(x: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes chosen from the code points ``x``."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h = gram_hashes(x, min(k, len(x)))
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # rightmost of equal hashes
    least = sliding_min(key, min(window, len(h)))
    least = least[np.append(True, least[1:] != least[:-1])]
    return (low - (least & low)).astype(np.int64), (least >> np.uint64(32)).astype(np.uint32)


def packed(at: np.ndarray, h: np.ndarray) -> str:
    """Hex of the chosen hashes in text order, each followed by its distance from the one before (at most a window)."""
    out = np.empty(len(h), np.dtype([("h", ">u4"), ("gap", "u1")]))
    out["h"], out["gap"] = h, np.diff(at, prepend=0)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def followed(rows: DataFrame) -> DataFrame:
    """``rows(rid, ...)`` with ``part`` and ``tail``: parts hold falling row keys; a tail row is the next part's first again.

    Parts are ranges of row keys, which are unique, so none is larger than others; their first keys reach the driver, one
    for each part. A text is shuffled once, and a part's first row once more.
    """
    n = parts_of(rows.sparkSession) * 4
    ranged = rows.select("rid").repartitionByRange(n, F.desc("rid"))
    tops = np.array(sorted(r["k"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.max("rid").alias("k")).collect()), np.int64)

    @F.pandas_udf("array<int>")
    def dealt(k: pd.Series) -> pd.Series:
        v = k.to_numpy()
        own = np.searchsorted(tops, v)  # the part whose first key is the least of those not below
        head = tops[own] == v
        closes = (own + 1) % len(tops)  # the first part closes the last
        return pd.Series([[int(p), int(c)] if h else [int(p)] for p, c, h in zip(own, closes, head, strict=True)])

    return rows.select("*", F.posexplode(dealt("rid")).alias("tail", "part"))


class _Mark:
    """What is kept of one text while its neighbour is looked at."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.codes = codes(text)
        self.at, self.hashes = winnow(self.codes)
        self.set = np.unique(self.hashes)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, part = None, None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for b in batches:
        out = []
        for doc_id, text, p, tail in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "part", "tail")), strict=True):
            if p != part:
                held, part = None, p
            elif held is False:
                continue  # one row closes a part
            now = _Mark(doc_id, text or "")
            if held is not None:
                changed = edited(held.text, now.text)
                at, h = winnow(codes(changed))
                out.append((held.doc_id, len(held.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), packed(held.at, held.hashes), packed(at, h), likeness(held.set, np.unique(h)), likeness(held.set, now.set)))
            held = False if tail else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, hashes array<struct<position, hash>>)`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"position": int(p), "hash": int(h)} for p, h in zip(*winnow(codes(t or "")), strict=True)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("position", pa.int64()), ("hash", pa.int64())])))], names=["doc_id", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<struct<position: long, hash: long>>")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's."""
    rows = keyed(docs).select("rid", "doc_id", "text")
    dealt = followed(rows).repartition(parts_of(docs.sparkSession), "part").sortWithinPartitions(F.col("part"), F.col("tail"), F.col("rid").desc())
    return dealt.select("doc_id", "text", "part", "tail").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
