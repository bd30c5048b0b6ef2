"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors: a token's hash names one of VOCABULARY rows; each row has a fixed sparse ternary
index vector and gathers the index vectors of its neighbours over the whole corpus (random
indexing). Every task sums in one table of fixed size; the tables are added up by chunk, so memory does
not grow with the corpus. A document is the frequency-weighted mean of its tokens' vectors. The network
is trained on a bounded sample of labelled rows (TRAIN_ROWS, the least seeded hashes of the ids), and
its temperature is fitted on a part of the sample that training does not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, _slices, clear_of, crc_mod, grouped, mix, raw_texts, read, sheltered

VOCABULARY = 1 << 13
DIMS = 64
NONZERO = 8
CHUNK = 128               # rows of the table per shuffled piece
TRAIN_ROWS = 20_000       # labelled rows the network is fitted on, at most
HIDDEN = 32
EPOCHS, STEPS = 20, 1200  # at least
PRIOR_TOKENS = 20.0     # of zero vectors in every mean, so that short texts do not get extreme ones
THRESHOLD = 0.7
SEED = 5
SMOOTH = 1e-3             # tokens rarer than this share weigh most in the mean
CAPITALS, REPEAT = 0, 1   # rows kept for marks of all-capital words and of repeats

_CLASS = np.full(256, 1, np.uint8)        # letters, digits, bytes beyond ASCII
_CLASS[:128] = [0 if chr(c).isspace() else 1 if chr(c).isalnum() else 2 for c in range(128)]


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((VOCABULARY, DIMS), np.int8)
    at = np.argsort(rng.random((VOCABULARY, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice([-1, 1], (VOCABULARY, NONZERO)).astype(np.int8), axis=1)
    return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all tokens in order, the text of each, and (texts, 2) counts of the two marks.

    Tokens are runs of word characters (A-Z lower-cased) and runs of other printable characters.
    """
    rows, owner, marks = [], [], np.zeros((len(texts), 2), np.float32)
    for lo, hi in grouped(texts):
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        at = 0
        for piece in _slices(b"\n".join(texts[lo:hi])):
            raw = np.frombuffer(piece, np.uint8)
            a = np.frombuffer(piece.lower(), np.uint8)
            kind = _CLASS[a]
            edge = np.flatnonzero(np.diff(kind)) + 1
            first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(a)]))
            keep = kind[first] > 0 if len(a) else np.zeros(len(first), bool)
            first, last = first[keep], last[keep]
            if len(first):
                up, down = _powers(len(a) + 1, 0)
                sums = np.zeros(len(a) + 1, np.uint64)
                np.cumsum(_BYTE[a] * up[:len(a)], out=sums[1:])
                h = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
                of = lo + np.searchsorted(ends, first + at, side="right")
                caps = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
                small = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
                loud = (caps[last] - caps[first] >= 2) & (small[last] == small[first])
                again = np.zeros(len(h), bool)
                word = kind[first] == 1
                for d in (1, 2):  # the word before, or the one before the mark between
                    again[d:] |= (h[d:] == h[:-d]) & word[d:] & (of[d:] == of[:-d])
                marks[:, CAPITALS] += np.bincount(of[loud], minlength=len(texts))
                marks[:, REPEAT] += np.bincount(of[again], minlength=len(texts))
                rows.append((2 + h % np.uint64(VOCABULARY - 2)).astype(np.int32))
                owner.append(of)
            at += len(piece)
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), marks
    return np.concatenate(rows), np.concatenate(owner), marks


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for every row the sum of its neighbours' index vectors, and its count, by chunk."""
    index = index_vectors().astype(np.int16)
    table = np.zeros((VOCABULARY, DIMS + 1), np.int64)
    for b in batches:
        texts = raw_texts(b.column(0))
        for lo, hi in grouped(texts):
            rows, owner, _ = tokens(texts[lo:hi])
            for s in range(0, len(rows), 1 << 17):
                r, o = rows[s:s + (1 << 17)], owner[s:s + (1 << 17)]
                near = np.zeros((len(r), DIMS), np.int16)
                same = (o[1:] == o[:-1])[:, None]
                near[1:] += index[r[:-1]] * same
                near[:-1] += index[r[1:]] * same
                order = np.argsort(r, kind="stable")
                own, start = np.unique(r[order], return_index=True)
                table[own, :DIMS] += np.add.reduceat(near[order], start, axis=0, dtype=np.int32)
                table[own, DIMS] += np.diff(np.append(start, len(r)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(VOCABULARY // CHUNK, dtype=np.int32)),
         pa.array([table[i:i + CHUNK].tobytes() for i in range(0, VOCABULARY, CHUNK)])], names=["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk's pieces, one piece at a time."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            more = np.frombuffer(piece, np.int64)
            held[chunk] = held[chunk] + more if chunk in held else more
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                      pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                     names=["chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The weighted vectors of all rows (VOCABULARY x DIMS), from every text of ``docs``."""
    schema = "chunk int, sums binary"
    parts = (docs.select("text").mapInArrow(_contexts, schema).repartition(VOCABULARY // CHUNK, "chunk")
             .mapInArrow(_added, schema).collect())
    table = np.zeros((VOCABULARY, DIMS + 1), np.int64)
    for chunk, sums in parts:
        table[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(sums, np.int64).reshape(CHUNK, DIMS + 1)
    index = index_vectors().astype(np.float64) / np.sqrt(NONZERO)
    near, count = table[:, :DIMS].astype(np.float64), table[:, DIMS].astype(np.float64)
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    weight = SMOOTH / (SMOOTH + count / max(count.sum(), 1.0))
    weight[[CAPITALS, REPEAT]] = 1.0
    return ((index + near) * weight[:, None]).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean token vectors (len(texts) x DIMS), drawn to zero for short texts; without tokens all zeros."""
    out, n = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.float32)
    for lo, hi in grouped(texts):
        rows, owner, marks = tokens(texts[lo:hi])
        for s in range(0, len(rows), 1 << 17):
            o = owner[s:s + (1 << 17)]
            own, start = np.unique(o, return_index=True)
            out[lo + own] += np.add.reduceat(vectors[rows[s:s + (1 << 17)]], start, axis=0)
        out[lo:hi] += marks @ vectors[[CAPITALS, REPEAT]]
        n[lo:hi] = np.bincount(owner, minlength=hi - lo)
    return out / (n + PRIOR_TOKENS)[:, None]


@dataclass
class Network:
    """Two layers on standardised inputs; probabilities are calibrated by one temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss; without both labels the score is the share of label 1 (1 if there are no rows)."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    share = float(y.mean()) if len(y) else 1.0
    if len(np.unique(y)) < 2:
        prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), prior)
    order = rng.permutation(len(y))
    held, train = order[:max(1, len(y) // 6)], order[max(1, len(y) // 6):]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (x - mean) / scale
    batches = max(1, len(train) // 256)
    for _ in range(max(EPOCHS, STEPS // batches)):
        for rows in np.array_split(rng.permutation(train), batches):
            xb, yb = z[rows], y[rows]
            hidden = np.tanh(xb @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3][0], -40, 40)))
            e = (out - yb) / len(rows)
            back = np.outer(e, p[2]) * (1 - hidden ** 2)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.005 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    raw, truth = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(raw / t, -40, 40))), 1e-7, 1 - 1e-7)
        return float(-(truth * np.log(q) + (1 - truth) * np.log(1 - q)).mean())

    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    """The network from a bounded sample of the labelled rows that are not held out."""
    sample = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
              .select("doc_id", "quality").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality")
              .limit(TRAIN_ROWS))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(raw_texts(b.column(2)), vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()),
                                              pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["doc_id", "quality", "x"])

    rows = (docs.select(F.col("doc_id").alias("_d"), "text")
            .join(F.broadcast(sample), F.col("_d") == F.col("doc_id")).select("doc_id", "quality", "text")
            .mapInArrow(features, "doc_id long, quality int, x binary").collect())
    rows = sorted(map(tuple, rows))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), DIMS)
    return fit(x, np.array([r[1] for r in rows], np.float64))


def with_score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1 from the whole text (null: empty)."""
    spark = docs.sparkSession
    docs = clear_of(docs, "score")
    at = docs.columns.index("text")
    shared = spark.sparkContext.broadcast((vectors, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = shared.value
        for b in batches:
            s = network.scores(pooled(raw_texts(b.column(at)), table).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType
    return docs.mapInArrow(score, StructType([*docs.schema.fields]).add("score", DoubleType()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, trained on ``docs`` and ``labels``. Every row is scored, repeated and null ids too."""
    vectors = word_vectors(docs)
    return with_score(docs, vectors, train(docs, labels, vectors))


@sheltered("score")
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with the same columns."""
    return score_documents(docs, labels).filter(F.col("score") >= threshold).select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
