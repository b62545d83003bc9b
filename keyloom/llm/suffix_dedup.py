"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``min_len`` (100) bytes that covers it also starts earlier in the input (smaller document,
or same document and earlier start). How the whole corpus gets there without one global suffix array:

1. Every ``min_len``-byte string has one anchor: the rightmost least hash among its 24-byte grams. Equal strings have
   equal anchors, so only strings whose anchor hash occurs twice can repeat, and strings with different anchors never
   have to meet. Consecutive strings with the same anchor form one *passage* (at most 176 bytes).
   Which anchors repeat is found from sketches: each part of the documents sends its anchors' hashes with their counts
   to ranges of hashes, and hears back which of them occur elsewhere too.
2. Passages of repeated anchors are grouped by anchor. A part of the documents first folds its own identical passages (their later
   occurrences are repeats already). Passages of an anchor with more than ``hot`` occurrences are cut where their
   strings' offsets to the anchor pass a multiple of 20, and each piece is grouped by the bytes that all its strings
   hold; with more than ``hottest`` occurrences they are cut into single strings, grouped by themselves. So a group
   holds no more than ``hottest`` passages, or one string once for each part.
3. Each bucket of groups is cut into shards; a shard's suffixes are sorted and give its transform. The shards are
   merged by iterative interleave refinement: starting from the plain concatenation, each round deals the interleave
   stably by the preceding symbol, so that after h rounds suffixes are in the order of their first h symbols, and the
   boundaries found in round h mark common prefixes of h-1 symbols. No suffixes of different shards are compared.
   A symbol is a block of ten bytes and the transform steps ten bytes back (the ten phases of a passage are ten
   strings over that alphabet), so ten rounds give the intervals of 100 repeated bytes.
4. In each interval all but the earliest start are repeats; covered bytes are united per document.

What one task holds is bounded: a group of at most ``hottest`` passages (176 bytes each) or one string once for each part, a part
of the documents, and the hashes of one range, a ``MOST_RANGES``-th of all anchors or the share of a task, if that is more.
Sketches have a row only where a part has anchors in a range, so they are never more rows than anchors.

Defined cases: null text is empty; texts under 100 bytes are never touched; a very long text is read in slices that overlap; null ids sort before all ids and repeated
ids are told apart by their texts' order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import chunks, gram_hashes, keyed, parts_of, sliding_min, texts

GRAM = 24
STEP = 10
PIECE = 20
#: Bytes of passages merged at once, and of one shard.
BUCKET, SHARD = 1 << 19, 1 << 16
#: Parts of documents for each shuffle partition, and the most ranges that anchors' hashes are dealt to.
PARTS_A_TASK, MOST_RANGES = 4, 1 << 19
#: Occurrences of an anchor beyond which its passages are cut into pieces, and into single strings.
HOT, HOTTEST = 256, 1 << 15


def anchors(bufs: list[bytes], min_len: int) -> tuple[np.ndarray, ...]:
    """Row, start, number of strings, anchor offset and anchor hash of each passage of the texts."""
    out = []
    sizes = [len(b) for b in bufs]
    for i, j in chunks(sizes):
        buf = np.frombuffer(b"".join(bufs[i:j]), np.uint8)
        n = len(buf) - min_len + 1
        if n <= 0:
            continue
        h = gram_hashes(buf, GRAM)
        w = min_len - GRAM + 1
        low, most = np.uint64((1 << 24) - 1), (1 << 24) - w
        at = np.empty(n, np.int64)
        for k in range(0, n, most):  # rightmost least hash: 40 bits of hash, then the position in the slice, later ones first
            part = h[k : min(k + most, n) + w - 1]
            at[k : k + most] = k + (low - (sliding_min((part & ~low) | (low - np.arange(len(part), dtype=np.uint64)), w) & low)).astype(np.int64)
        ends = np.cumsum(sizes[i:j])
        begins = ends - sizes[i:j]
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        starts = np.unique(np.concatenate([[0], turn, begins[begins < n]]))
        row = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], n), ends[row] - min_len + 1)
        ok = stops > starts
        starts, stops, row = starts[ok], stops[ok], row[ok]
        pos = at[starts]
        out.append((row + i, starts - begins[row], stops - starts, pos - starts, h[pos].view(np.int64)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sketches(min_len: int, ranges: int):
    """Texts -> for each part of the documents and range of hashes, its anchors' hashes and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, _, _, f = anchors([t.encode() for t in texts(b)], min_len)
            f = f.view(np.uint64)
            part = np.asarray(b.column("part"))[row]
            r = (f & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)  # anchors are least hashes: only their low bits are even
            order = np.lexsort((f, r, part))
            f, part, r = f[order], part[order], r[order]
            head = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (part[1:] != part[:-1]))) if len(f) else np.empty(0, np.int64)
            n = np.diff(np.append(head, len(f))).astype(np.uint32)
            f, part, r = f[head], part[head], r[head]
            cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (part[1:] != part[:-1]))) if len(f) else head
            ends = np.append(cut[1:], len(f))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[cut].astype(np.int32)), pa.array(part[cut].astype(np.int32)), pa.array([f[i:j].tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary())],
                names=["range", "part", "f", "c"],
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches sorted by range -> for each part its anchors that occur twice or more, and how often in all."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    now = None

    def close() -> pa.RecordBatch:
        f, back = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([x[2] for x in held])).astype(np.int64)
        rows, at = [], 0
        for part, own, _ in held:
            c = total[back[at : at + len(own)]]
            at += len(own)
            if (c > 1).any():
                rows.append((part, own[c > 1].tobytes(), np.minimum(c[c > 1], 0xFFFFFFFF).astype(np.uint32).tobytes()))
        part, fs, cs = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(fs, pa.binary()), pa.array(cs, pa.binary())], names=["part", "f", "c"])

    for b in batches:
        for r, part, f, c in zip(*(b.column(x).to_pylist() for x in ("range", "part", "f", "c")), strict=True):
            if r != now and held:
                yield close()
                held = []
            now = r
            held.append((part, np.frombuffer(f, np.uint64), np.frombuffer(c, np.uint32)))
    if held:
        yield close()


PASSAGES = pa.schema([("gid", pa.int64()), ("passage", pa.binary()), ("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, stop) with overlapping and touching spans of a row made one."""
    out: list[list[int]] = []
    for rid, start, stop in sorted(spans):
        if out and out[-1][0] == rid and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([rid, start, stop])
    return [tuple(x) for x in out]


class _Fold:
    """Identical passages of one task: the earliest goes on, later ones are repeats."""

    MOST = 200_000

    def __init__(self, min_len: int) -> None:
        self.first: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.min_len = min_len
        self.gone: list[tuple[int, int, int]] = []

    def add(self, gid: int, passage: bytes, rid: int, start: int) -> None:
        was = self.first.setdefault((gid, passage), (rid, start))
        if was != (rid, start):
            late = max(was, (rid, start))
            if late is was:
                self.first[gid, passage] = (rid, start)
            self.gone.append((late[0], late[1], late[1] + len(passage)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.first and not self.gone:
            return
        keys, at = list(self.first), list(self.first.values())
        m, g = len(keys), united(self.gone)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys] + [None] * len(g), pa.int64()),
                pa.array([k[1] for k in keys] + [None] * len(g), pa.binary()),
                pa.array([x[0] for x in at] + [x[0] for x in g], pa.int64()),
                pa.array([x[1] for x in at] + [x[1] for x in g], pa.int64()),
                pa.array([None] * m + [x[2] for x in g], pa.int64()),
            ],
            names=["gid", "passage", "rid", "start", "stop"],
        )
        self.first, self.gone = {}, []


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _passages(min_len: int, hot: int, hottest: int):
    """A part's texts and repeated anchors -> folded passages (stop null) and repeats found on the way."""

    def run(docs: pa.Table, often: pa.Table) -> pa.Table:
        fold, out = _Fold(min_len), []
        f = np.frombuffer(b"".join(often.column("f").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(often.column("c").to_pylist()), np.uint32)
        f, first = np.unique(f, return_index=True)
        c = c[first]
        if len(f):
            rids = docs.column("rid").to_pylist()
            bufs = [(t or "").encode() for t in docs.column("text").to_pylist()]
            row, start, n, off, own = anchors(bufs, min_len)
            at = np.searchsorted(f, own.view(np.uint64)).clip(max=len(f) - 1)
            hit = f[at] == own.view(np.uint64)
            for k, s, m, o, g, times in zip(*(x[hit].tolist() for x in (row, start, n, off, own)), c[at[hit]].tolist(), strict=True):
                buf, rid, stop, anchor = bufs[k], rids[k], s + m, s + o
                if times <= hot:
                    fold.add(g, buf[s : stop - 1 + min_len], rid, s)
                elif times > hottest:
                    for i in range(s, stop):
                        one = buf[i : i + min_len]
                        fold.add(_digest(one), one, rid, i)
                else:
                    while s < stop:
                        most = (anchor - s) // PIECE * PIECE  # this piece's strings start at most PIECE - 1 before it
                        end = min(stop, anchor - most + 1)
                        core = buf[anchor - most : anchor - most - PIECE + 1 + min_len]
                        fold.add(_digest(g.to_bytes(8, "little", signed=True), bytes([most]), core), buf[s : end - 1 + min_len], rid, s)
                        s = end
                if len(fold.first) + len(fold.gone) > fold.MOST:
                    out += fold.flush()
        out += fold.flush()
        return pa.Table.from_batches(out, PASSAGES)

    return run


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _stable(c: np.ndarray) -> np.ndarray:
    """Stable order of non-negative symbols below 2**32, by two radix passes."""
    p = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    hi = c >> 16
    return p[np.argsort(hi[p].astype(np.uint16), kind="stable")] if hi.any() else p


def shard_transform(symbol: np.ndarray, first: np.ndarray, lens: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order (rows of the shard, to ``rounds`` symbols) and preceding symbols of one shard's strings.

    ``symbol`` holds the block at each row; a string has STEP closing rows with symbol 0. A row's next symbol stands
    STEP rows on. Prefixes are ranked by doubling inside the shard only.
    """
    n = len(symbol)
    string = np.repeat(np.arange(len(lens)), lens)
    last = (first + lens - STEP)[string]  # closing rows stay where they are
    rank, span = symbol, 1
    while span < rounds:
        step = min(span, rounds - span)
        nxt = np.arange(n) + STEP * step
        nxt = np.where(nxt < last + STEP, np.minimum(nxt, n - 1), -1)
        follow = np.where(nxt >= 0, rank[nxt] + 1, 0)
        rank = _ranks(rank * np.int64(n + 2) + follow) if rank.max(initial=0) <= n else _ranks(_ranks(rank) * np.int64(n + 2) + _ranks(follow))
        span += step
    order = np.argsort(rank, kind="stable")
    rows = np.arange(n) - first[string]
    before = np.where(rows[order] >= STEP, symbol[np.maximum(order - STEP, 0)], 0)
    return order, before


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms: the merged order (indices into their concatenation) and its interval ids.

    The interleave only says which shard the next row comes from; each round deals it stably by preceding symbol.
    Rows stay in one interval while their first h symbols are equal. Rows whose preceding symbol is the closing mark
    return to the closing rows, which all compare equal.
    """
    sizes = [len(t) for t in transforms]
    bwt = np.concatenate(transforms)
    n = len(bwt)
    source = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint8)
    row, group = np.arange(n), np.zeros(n, np.int32)
    for _ in range(rounds):
        c = bwt[row]
        deal = _stable(c)
        source, c, g = source[deal], c[deal], group[deal]
        turn = np.empty(n, bool)
        turn[:1] = False
        turn[1:] = (c[1:] != c[:-1]) | ((g[1:] != g[:-1]) & (c[1:] != 0))
        group = np.cumsum(turn, dtype=np.int32)
        row = np.empty(n, np.int64)
        row[np.argsort(source, kind="stable")] = np.arange(n)
    return row, group


def repeats(passages: list[bytes], earlier: np.ndarray, min_len: int) -> Iterator[tuple[int, int, int]]:
    """(passage, from, to): runs of string starts that also occur in a passage of smaller ``earlier`` rank."""
    rounds, rest = divmod(min_len, STEP)
    assert rest == 0, "min_len must be a multiple of ten"
    lens = np.array([len(p) for p in passages]) + STEP
    first = np.cumsum(lens) - lens
    pad = bytes(STEP)
    buf = np.frombuffer(b"".join(p + pad for p in passages) + pad, np.uint8).astype(np.uint64)
    n = int(lens.sum())
    five = buf[: n + 5].copy()
    for i in range(1, 5):
        five = five[: n + 5] * np.uint64(256)
        five += buf[i : i + n + 5]
    half = _ranks(five)
    symbol = _ranks(half[:n] * np.int64(len(half) + 1) + half[5 : n + 5]) + 1
    string = np.repeat(np.arange(len(lens)), lens)
    symbol[np.arange(n) >= (first + lens - STEP)[string]] = 0
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, n, max(SHARD, n // 200 + 1))), len(lens)))
    orders, transforms = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = int(first[i]), int(first[j - 1] + lens[j - 1])
        order, before = shard_transform(symbol[a:b], first[i:j] - a, lens[i:j], rounds)
        orders.append(order + a)
        transforms.append(before)
    row, group = merge_transforms(transforms, rounds)
    suffix = np.concatenate(orders)[row]
    whole = suffix + min_len <= (first + lens - STEP)[string[suffix]]
    suffix, group = suffix[whole], group[whole]
    if not len(suffix):
        return
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = earlier[string[suffix]]
    least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(rank))))
    gone = np.zeros(n, bool)
    gone[suffix[rank > least]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        k = int(string[a])
        yield k, int(a - first[k]), int(b - first[k])


def _merge(min_len: int):
    """Folded passages, sorted by group -> repeats. Groups with one distinct passage have nothing to be merged with."""

    def of(held: list[tuple[bytes, tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
        by_place = sorted(range(len(held)), key=lambda i: held[i][1])
        earlier = np.empty(len(held), np.int64)
        earlier[by_place] = np.arange(len(held))
        for k, a, b in repeats([p for p, _ in held], earlier, min_len):
            rid, start = held[k][1]
            yield rid, start + a, start + b - 1 + min_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, tuple[int, int]]] = []
        group: dict[bytes, tuple[int, int]] = {}
        gid, size, gone = None, 0, []

        def close() -> None:
            nonlocal size, group
            if len(group) > 1:
                held.extend(group.items())
                size += sum(map(len, group))
            group = {}

        for b in batches:
            for g, p, rid, start in zip(*(b.column(x).to_pylist() for x in ("gid", "passage", "rid", "start")), strict=True):
                if g != gid:
                    close()
                    gid = g
                    if size >= BUCKET:
                        gone.extend(of(held))
                        held, size = [], 0
                was = group.setdefault(p, (rid, start))
                if was != (rid, start):
                    late = max(was, (rid, start))
                    group[p] = min(was, (rid, start))
                    gone.append((late[0], late[1], late[1] + len(p)))
            if gone:
                yield _spans(gone)
                gone = []
        close()
        if held:
            gone.extend(of(held))
        if gone:
            yield _spans(gone)

    return run


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = united(rows)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["rid", "start", "stop"])


def _kept(docs: pa.Table, cover: pa.Table, as_text: bool) -> pa.Table:
    """A part's texts and repeats -> what is kept of each text, as bytes, or as text without code points that were cut into."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for x in united(list(zip(*(cover.column(c).to_pylist() for c in ("rid", "start", "stop")), strict=True))):
        spans.setdefault(x[0], []).append(x)
    kept, removed, runs, sizes = [], [], [], []
    for rid, text in zip(docs.column("rid").to_pylist(), docs.column("text").to_pylist(), strict=True):
        buf = (text or "").encode()
        out, at = [], 0
        for _, start, stop in spans.get(rid, ()):
            out.append(buf[at:start])
            at = stop
        out.append(buf[at:])
        kept.append(b"".join(out))
        sizes.append(len(buf))
        removed.append(len(buf) - len(kept[-1]))
        runs.append(len(spans.get(rid, ())))
    left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    return pa.table([docs.column("doc_id"), left, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), docs.column("rest")], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "rest"])


def _apply(docs: pa.Table, cover: pa.Table) -> pa.Table:
    return _kept(docs, cover, False)


def _apply_as_text(docs: pa.Table, cover: pa.Table) -> pa.Table:
    return _kept(docs, cover, True)


def dedup(docs: DataFrame, min_len: int = 100, hot: int = HOT, hottest: int = HOTTEST, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, n_spans, *carry)`` for each row of ``docs(doc_id, text, *carry)``.

    ``kept`` is binary, or with ``as_text`` a string from which code points that a removal has cut into are left out.
    """
    if min_len % STEP or min_len <= GRAM:
        raise ValueError(f"min_len must be a multiple of {STEP} over {GRAM}")
    n = parts_of(docs.sparkSession)
    parts, ranges = PARTS_A_TASK * n, min(n, MOST_RANGES)
    part = F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    text = keyed(docs, carry).withColumn("part", part).repartition(n, "part")  # the one shuffle of texts, read three times
    sketches = text.mapInArrow(_sketches(min_len, ranges), "range int, part int, f binary, c binary")
    sketches = sketches.repartition(ranges, "range").sortWithinPartitions("range")
    often = sketches.mapInArrow(_repeated, "part int, f binary, c binary").repartition(n, "part")
    found = text.groupBy("part").cogroup(often.groupBy("part")).applyInArrow(_passages(min_len, hot, max(hot, hottest)), "gid long, passage binary, rid long, start long, stop long")
    found = found.repartition(n, F.coalesce("gid", F.xxhash64("rid", "start"))).sortWithinPartitions("gid")
    gone = found.mapInArrow(_merge_or_pass(min_len), "rid long, start long, stop long").withColumn("part", part).repartition(n, "part")
    kinds = f"doc_id long, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long, rest {dict(text.dtypes)['rest']}"
    out = text.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(_apply_as_text if as_text else _apply, kinds)
    return out.select("doc_id", "kept", "n_bytes", "n_removed", "n_spans", *(f"rest.`{c}`" for c in carry or ()))


def _merge_or_pass(min_len: int):
    merge = _merge(min_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def open_ones() -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                is_open = t["stop"].is_null()
                done = t.filter(pa.compute.invert(is_open)).select(["rid", "start", "stop"])
                passed.extend(done.to_batches())
                yield from t.filter(is_open).to_batches()

        for out in merge(open_ones()):
            yield out
            while passed:
                yield passed.pop()
        yield from passed

    return run
