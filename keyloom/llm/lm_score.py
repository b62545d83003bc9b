"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

The vocabulary comes from counts over the whole corpus of N words and grows with it: the sqrt(N) / 2 most frequent words
(768 at least) have an id each, all others share hashed ids, one to eight of these (256 at least). The network sums one
embedding per context place (``SIDE`` words to the left and to the right), takes tanh, and predicts the class of the
masked word and then the word within its class (two softmaxes of about the root of the number of ids). It is written in
numpy. A word with a shared id has P(id | both sides) times its share of that id's count in the corpus. Tasks hold
the counts of up to ``KNOWN`` words, which changes no result; those of rarer words are joined. A document's score is
the sum of log P(word | both sides) over all of its words.

Training predicts every word of all documents once in ``ROUNDS`` passes: a task starts from the common model, masks every
``stride``-th place of each document (from a place that moves on by one with the pass; the stride is ``MASK``, or the
number of passes if that is less), takes Adagrad steps, and hands over its parameters and the number of places it learnt from; these are summed with weights in two steps, keyed by parameter block
and salted, so what is gathered grows with the input and no task or driver holds more than a model's worth of sums.

Defined cases: null and blank texts have no words, score 0 and a null mean; a text's ends are padded, and no context
crosses documents; long texts are scored in slices that overlap by the window; repeated rows give repeated results and
count twice in training; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, one_thread, parts_of, texts

SIDE = 2
DIM = 16
#: The least numbers of ids, and of those that rarer words share.
VOCAB = 1024
OOV = 256
#: The last row of the embeddings, whatever their number.
PAD = -1
KNOWN = 200_000
ROUNDS = 2
MASK = 2
STEP = 16384
RATE = 0.1
MOST = np.float32(60)
SLICE = 1 << 16
WORD_BYTES = 64
COUNTED = 500_000
BLOCKS = 16

PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


class Vocabulary(dict):
    """Word -> code: the place among the known words, most frequent first, or beyond them by the id shared with other words.

    ``ids`` has the network's id of each code. ``own`` has what a word adds to the log-probability of its id: 0 with an
    id of its own, else the log of its share; beyond the known words the log of its count is still to be added.
    """

    def __init__(self, words: list[str], n: np.ndarray, single: int, shared: np.ndarray) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.args = words, n, single, shared
        self.known, self.buckets, self.size = len(words), len(shared), single + len(shared)
        hashed = np.array([bucket(w, len(shared)) for w in words[single:]], np.int64)
        self.ids = np.concatenate([np.arange(min(single, len(words))), single + hashed, np.arange(single, self.size)])
        with np.errstate(divide="ignore"):
            less = -np.log(shared)  # infinite where no word is; such codes do not occur
        self.own = np.concatenate([np.zeros(min(single, len(words))), np.log(n[single:]) + less[hashed], less])

    def __missing__(self, word: str) -> int:
        return self.known + bucket(word, self.buckets)

    def __reduce__(self):
        return Vocabulary, self.args


def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def tokens(text: str) -> list[str]:
    """The words of a text; a digest of 65 characters stands for a longer one than ``WORD_BYTES``."""
    found = text.lower().split()
    if max(map(len, found), default=0) <= WORD_BYTES:
        return found
    return [w if len(w) <= WORD_BYTES else "#" + hashlib.sha256(w.encode()).hexdigest() for w in found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in texts(b):
            counts.update(tokens(t))
        if len(counts) > COUNTED:
            yield out()
            counts.clear()
    yield out()


def layout(vocab: int) -> tuple[int, int]:
    """Classes and members of a class, for at least ``vocab`` ids."""
    classes = math.isqrt(vocab - 1) + 1
    return classes, -(-vocab // classes)


def vocabulary(rows: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary of the corpus, a count for each id, and ``(word, n)`` of all words."""
    counts = rows.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("size", F.floor(F.log("n") * 8).cast("int")))
    # words by the size of their counts (a few hundred sizes), so that only words near the top are ever sorted
    sizes = counts.groupBy("size").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()
    single = max(VOCAB - OOV, math.isqrt(sum(r["n"] for r in sizes)) // 2)
    buckets = math.prod(layout(single + max(OOV, single // 8))) - single
    least, words = 0, 0
    for r in sizes:
        if words >= single and words + r["words"] > KNOWN:
            break
        least, words = r["size"], words + r["words"]
    top = counts.where(F.col("size") >= least).select("word", "n")
    top = (top.orderBy(F.desc("n"), "word").limit(single) if words > max(single, KNOWN) else top).collect()
    top.sort(key=lambda r: (-r["n"], r["word"].encode()))
    names, n = [r["word"] for r in top], np.array([r["n"] for r in top], np.float64)
    shared = np.zeros(buckets)
    for r in counts.groupBy((F.crc32(F.encode("word", "UTF-8")) % buckets).alias("b")).agg(F.sum("n").alias("n")).collect():
        shared[r["b"]] = r["n"]
    for w, k in zip(names[:single], n[:single], strict=True):
        shared[bucket(w, buckets)] -= k
    of_ids = np.ones(single + buckets)
    of_ids[: len(n[:single])] = n[:single]
    of_ids[single:] = np.maximum(shared, 1)
    return Vocabulary(names, n, single, shared), of_ids, counts.select("word", "n")


class Network:
    """Parameters: context embeddings by place, class weights and biases, word weights and biases by class."""

    def __init__(self, flat: np.ndarray, vocab: int = VOCAB) -> None:
        self.flat, self.vocab = flat, vocab
        self.classes, self.members = layout(vocab)
        at = 0
        for name, shape in self.shapes(vocab).items():
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def shapes(vocab: int) -> dict[str, tuple[int, ...]]:
        classes, members = layout(vocab)
        return {"embed": (len(PLACES), vocab + 1, DIM), "lift": (DIM,), "cw": (DIM, classes), "cb": (classes,), "ww": (classes, DIM, members), "wb": (classes, members)}

    @classmethod
    def size(cls, vocab: int = VOCAB) -> int:
        return sum(map(math.prod, cls.shapes(vocab).values()))

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random embeddings; biases that give the corpus frequencies."""
        net = cls(np.zeros(cls.size(len(counts)), np.float32), len(counts))
        rng = np.random.default_rng(7)
        for x in (net.embed, net.cw, net.ww):
            x[...] = rng.normal(0, 0.1, x.shape)
        p = counts.reshape(net.members, net.classes).T / counts.sum()
        net.cb[...] = np.log(p.sum(axis=1))
        net.wb[...] = np.log(p / p.sum(axis=1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embed[0].take(context[0], axis=0, mode="wrap")
        h += self.lift
        for j in range(1, len(PLACES)):
            h += self.embed[j].take(context[j], axis=0, mode="wrap")
        return np.tanh(h, out=h)

    def _by_class(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Class of each word, the places in the order of classes, and (class, from, to) of those that occur."""
        cls = word % self.classes
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        return cls, order, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]

    def log_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P of each word (an id) given its context (places x words)."""
        h = self.hidden(context)
        cls, order, runs = self._by_class(word)
        out = _picked(self.cw.T @ h.T + self.cb[:, None], cls)
        h, member = h[order], (word // self.classes)[order]
        within = np.empty(len(word), out.dtype)
        for c, a, b in runs:
            within[a:b] = _picked(self.ww[c].T @ h[a:b].T + self.wb[c][:, None], member[a:b])
        out[order] += within
        return out

    def learn(self, context: np.ndarray, word: np.ndarray, seen: Network) -> None:
        """One Adagrad step on a batch; ``seen`` holds the sums of squared gradients."""
        n = np.float32(len(word))
        h = self.hidden(context)
        cls, order, runs = self._by_class(word)
        e = _slope(self.cw.T @ h.T + self.cb[:, None], cls) / n
        back = e.T @ self.cw.T
        steps = [("cw", (e @ h).T), ("cb", e.sum(axis=1))]
        sorted_h, member = h[order], (word // self.classes)[order]
        ww, wb, within = np.zeros_like(self.ww), np.zeros_like(self.wb), np.empty_like(h)
        for c, a, b in runs:
            hc = sorted_h[a:b]
            ec = _slope(self.ww[c].T @ hc.T + self.wb[c][:, None], member[a:b]) / n
            within[a:b] = ec.T @ self.ww[c].T
            ww[c], wb[c] = (ec @ hc).T, ec.sum(axis=1)
        back[order] += within
        back *= 1 - h * h
        for name, grad in [*steps, ("ww", ww), ("wb", wb), ("lift", back.sum(axis=0))]:
            acc, x = getattr(seen, name), getattr(self, name)
            acc += grad * grad
            x -= np.float32(RATE) * grad / (np.sqrt(acc) + np.float32(1e-6))
        for j in range(len(PLACES)):
            ids = (context[j] % (self.vocab + 1)).astype(np.min_scalar_type(self.vocab))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            grad, rows = np.add.reduceat(back.take(order, axis=0), head, axis=0), ids[head]
            squares = seen.embed[j][rows] + grad * grad
            seen.embed[j][rows] = squares
            self.embed[j][rows] -= np.float32(RATE) * grad / (np.sqrt(squares) + np.float32(1e-6))


# Logits have a row for each outcome and a column for each word, so that sums over outcomes run along whole columns at once.
# They are held below ``MOST``, of which the exponential is finite, in training and in scores alike.

def _picked(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
    np.minimum(logits, MOST, out=logits)
    at = logits[right, np.arange(len(right))]
    return at - np.log(np.exp(logits, out=logits).sum(axis=0))


def _slope(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
    np.minimum(logits, MOST, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    logits[right, np.arange(len(right))] -= 1
    return logits


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Contexts of the places ``at`` of padded ids."""
    return np.stack([ids[at + d] for d in PLACES])


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with SIDE pads around each document, and the places of the words."""
    gap = np.full(SIDE, PAD, np.int64)
    ids = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    return ids, np.flatnonzero(ids != PAD)


def _encode(vocab: Vocabulary):
    """Each text's ids, what its words with shared ids add to its score, and those whose counts are still to be joined."""
    kind = np.min_scalar_type(vocab.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, own, rare = [], [], [], []
            for t in texts(b):
                words = tokens(t)
                codes = np.fromiter(map(vocab.__getitem__, words), np.int64, len(words))
                left = np.flatnonzero(codes >= vocab.known)
                n.append(len(words))
                ids.append(vocab.ids[codes].astype(kind).tobytes())
                own.append(float(vocab.own[codes].sum()))
                rare.append(" ".join([words[i] for i in left]) if len(left) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(own, pa.float64()), pa.array(rare, pa.string())], names=["doc_id", "n_tokens", "ids", "own", "rare"])

    return run


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(row, doc_id, n_tokens, ids, own, rare)``, written once for the passes and the scores."""
    out = rows.mapInArrow(_encode(vocab), "doc_id long, n_tokens long, ids binary, own double, rare string")
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def _ids(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, kind).astype(np.int64) for x in batch.column("ids").to_pylist()]


def targets(docs: list[np.ndarray], turn: int, stride: int) -> np.ndarray:
    """Which words of the documents a pass predicts; ``stride`` passes on end predict each word once."""
    return np.concatenate([np.arange(len(d)) % stride == turn % stride for d in docs])


def _train(vocab: int, start: np.ndarray, turn: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net, seen = Network(start.copy(), vocab), Network(np.full(len(start), 1e-8, np.float32), vocab)
        held: list[np.ndarray] = []
        size = learnt = task = 0

        def learn() -> None:
            nonlocal held, size, learnt
            ids, places = _padded(held)
            places = places[targets(held, turn, stride)]
            for i in range(0, len(places), STEP):
                at = places[i : i + STEP]
                net.learn(windows(ids, at), ids[at], seen)
                learnt += len(at)
            held, size = [], 0

        for b in batches:
            task = b.column("task")[0].as_py() if b.num_rows else task
            for x in _ids(b, np.min_scalar_type(vocab)):
                if len(x):
                    held.append(x)
                    size += len(x)
                if size >= STEP * stride:
                    learn()
        if held:
            learn()
        if learnt:
            parts = np.array_split(net.flat.astype(np.float64) * learnt, BLOCKS)
            yield _sums([(i, task, float(learnt), p) for i, p in enumerate(parts)])

    return run


def _sums(rows: list[tuple[int, int, float, np.ndarray]]) -> pa.RecordBatch:
    block, task, weight, values = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(task, pa.int32()), pa.array(weight, pa.float64()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], names=["block", "task", "weight", "part"])


def _add(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for block, task, k, weight, part in zip(*(b.column(c).to_pylist() for c in ("block", "task", key, "weight", "part")), strict=True):
                x = np.frombuffer(part, np.float32).astype(np.float64)
                held = total.setdefault((block, k), [task, 0.0, np.zeros(len(x))])
                held[0], held[1] = min(held[0], task), held[1] + weight
                held[2] += x
        yield _sums([(block, task, w, x) for (block, _), (task, w, x) in total.items()])

    return run


def _trained(rows: DataFrame, start: Network, turn: int, stride: int) -> Network:
    kinds = "block int, task int, weight double, part binary"
    n = parts_of(rows.sparkSession)
    sums = rows.select("ids", F.spark_partition_id().alias("task")).mapInArrow(_train(start.vocab, start.flat, turn, stride), kinds)
    salted = sums.withColumn("salt", F.col("task") % max(1, n // BLOCKS)).repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "task")
    once = salted.mapInArrow(_add("salt"), kinds).repartition(min(n, BLOCKS), "block").sortWithinPartitions("block", "task")
    got = {r["block"]: (r["weight"], np.frombuffer(r["part"], np.float32)) for r in once.mapInArrow(_add("block"), kinds).collect()}
    if not got:
        return start
    return Network(np.concatenate([got[i][1] / np.float32(got[i][0]) for i in range(BLOCKS)]).astype(np.float32), start.vocab)


def train(rows: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Network:
    """The network of the encoded ``rows(ids)``, from a count for each id."""
    net = Network.fresh(counts)
    for turn in range(rounds):
        net = _trained(rows, net, turn, min(MASK, rounds))
    return net


def document_scores(docs: list[np.ndarray], net: Network) -> list[float]:
    """Summed conditional log-probabilities of each document's ids."""
    if not docs:
        return []
    ids, places = _padded(docs)
    lp = np.empty(len(places))
    for i in range(0, len(places), SLICE):
        at = places[i : i + SLICE]
        lp[i : i + SLICE] = net.log_prob(windows(ids, at), ids[at])
    ends = np.cumsum([len(d) for d in docs])
    return [float(lp[e - len(d) : e].sum()) for d, e in zip(docs, ends, strict=True)]


def scored(rows: DataFrame, counts: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_prob)`` of each of the encoded ``rows``; ``counts(word, n)`` of all words."""
    flat, vocab = net.flat, net.vocab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        own = Network(flat, vocab)
        for b in batches:
            held = _ids(b, np.min_scalar_type(vocab))
            out, i = [], 0
            while i < len(held):
                j, size = i, 0
                while j < len(held) and (j == i or size < SLICE):
                    size += len(held[j])
                    j += 1
                out += document_scores(held[i:j], own)
                i = j
            score = np.array(out, np.float64) + np.asarray(b.column("own"), np.float64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_tokens"), pa.array(score, pa.float64())], names=["row", "doc_id", "n_tokens", "score"])

    scores = rows.select("row", "doc_id", "n_tokens", "ids", "own").mapInArrow(run, "row long, doc_id long, n_tokens long, score double")
    # a word that occurs once adds log 1, so it has no need of a partner; no word here is frequent, as those are known
    rare = rows.where("rare is not null").select("row", F.explode(F.split("rare", " ")).alias("word"))
    more = rare.join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    out = scores.join(more, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_prob", F.expr("if(n_tokens > 0, log_likelihood / n_tokens, null)"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on ``docs`` and score them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocab, of_ids, counts = vocabulary(rows)
    coded = encoded(rows, vocab)
    return scored(coded, counts, train(coded, of_ids, rounds))
