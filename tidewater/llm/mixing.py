"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt by a seeded hash to shards of a bounded number of words and laid
end to end there in seeded order; each shard is cut into blocks of equal words. Seats (blocks) go
to sources by the highest quotients target / (2 seats + 1), and a source's seats to its shards in the
same way, giving an integer quota per shard. A quota beyond the shard's blocks takes whole rounds
first; the rest is a seeded, evenly spaced choice of blocks. What a document contributes follows
from its place by arithmetic, so no block list is ever built.

Driver memory: one row per source and per shard (at most MAX_SHARDS plus one per source).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, raw_texts, read, sheltered, shared_table

WEIGHTS = (1, 2, 3)          # of the sources in code point order, repeating; null last
MAX_REPEAT = 3               # a target's limit, in times its source's words
BLOCK_WORDS = 256            # of a block; less where the smallest source is small
SHARD_WORDS = 1 << 16        # of a shard, at least
MAX_SHARDS = 20_000
SEED = 7


def targets(sizes: list[int], weights: list[int], repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of all words by weight; what is above ``repeat`` times a source's words is reshared."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
            open_.discard(i)
        left = max(0.0, float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in open_))
    return out


def sainte_lague(shares: list[float], seats: int, limits: list[int]) -> list[int]:
    """``seats`` by highest quotients share / (2 k + 1), none above its limit (ties: first listed).

    Most seats follow from a divisor just too large, found by bisection; the last ones go one by one.
    """
    seats = min(seats, sum(limits))

    def at(scale: float) -> list[int]:
        return [min(m, math.floor(s * scale + 0.5)) if s > 0 else 0 for s, m in zip(shares, limits)]

    low, high = 0.0, 1.0
    while sum(at(high)) < seats and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(at(mid)) <= seats:
            low = mid
        else:
            high = mid
    given = at(low)
    heap = [(-s / (2 * k + 1), i) for i, (s, k, m) in enumerate(zip(shares, given, limits)) if k < m and s > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-shares[i] / (2 * given[i] + 1), i))
    return given


def _words(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sized: DataFrame, weights=WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(source -> shards, source and shard -> quota), both small, from rows (doc_id, source, _size)."""
    spark = sized.sparkSession
    rows = sorted(((r[0], r[1] or 0) for r in sized.groupBy("source").agg(F.sum("_size")).collect()),
                  key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    block = max(1, min(BLOCK_WORDS, min((n for n in sizes if n), default=1) // 256))
    shard_words = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    shards = spark.createDataFrame([(s, max(1, -(-n // shard_words))) for s, n in rows], "_s string, _shards int")
    dealt = _deal(sized, shards, seed).groupBy("source", "_shard").agg(F.sum("_size")).collect()
    held: dict = {}
    for s, k, n in sorted(dealt, key=lambda r: (r[0] or "", r[1])):
        held.setdefault(s, []).append((k, n))
    blocks = {s: [-(-n // block) for _, n in v] for s, v in held.items()}
    seats = sainte_lague(goal, round(total / block), [MAX_REPEAT * sum(blocks.get(s, [])) for s, _ in rows])
    out = []
    for (s, size), want, seat in zip(rows, goal, seats):
        own = held.get(s, [])
        each = sainte_lague([float(n) for _, n in own], seat, [MAX_REPEAT * b for b in blocks.get(s, [])])
        out += [(s, k, size, want, block, b, q // max(b, 1), q % max(b, 1))
                for (k, _), b, q in zip(own, blocks.get(s, []), each)]
    return shards, spark.createDataFrame(
        out, "_s string, _k int, source_size long, target double, _block long, _blocks long, _rounds long, _rest long")


def _deal(sized: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    return (sized.join(F.broadcast(shards), F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_shards")).cast("int"))
            .drop("_s", "_shards"))


def _placed(sized: DataFrame, shards: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """Each row with its word range [_from, _to) in its shard, the quota there, and the words taken."""
    order = (Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "_size")
             .rowsBetween(Window.unboundedPreceding, 0))
    df = (_deal(sized, shards, seed)
          .withColumn("_order", F.xxhash64(F.lit(seed + 1), "doc_id"))
          .withColumn("_to", F.sum("_size").over(order)).withColumn("_from", F.expr("_to - _size"))
          .join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")), "left")
          .withColumn("_start", F.when(F.col("_blocks") > 0, F.pmod(
              F.xxhash64(F.lit(seed + 2), "source", "_shard"), F.col("_blocks"))).otherwise(0)))
    # chosen blocks among the first i: (i * rest + start) div blocks; words taken of the first x words:
    upto = ("(_rounds * {x} + ((({x} div _block) * _rest + _start) div _blocks) * _block"
            " + (((({x} div _block) + 1) * _rest + _start) div _blocks - (({x} div _block) * _rest + _start) div _blocks)"
            " * ({x} % _block))")
    taken = f"CASE WHEN _blocks > 0 THEN {upto.format(x='_to')} - {upto.format(x='_from')} ELSE 0L END"
    return df.withColumn("taken", F.expr(taken)).drop("_order", "_s", "_k")


def mix_counts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target (of its source) and taken (words, repeats counted).

    A null source is a source of its own, last in order; null and empty texts have size 0 and
    take 0; rows of one doc_id are separate documents; reruns give the same rows.
    """
    sized = shared_table(docs.select("doc_id", "source", _words().alias("_size")), "mix-sizes")
    out = _placed(sized, *quotas(sized, seed=seed), seed)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


@sheltered("_size", "_shard", "_shards", "_s", "_k", "_order", "_to", "_from", "_start", "_block", "_blocks", "_rounds", "_rest",
           "source_size", "target", "taken")
def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document in as many rows as it is taken.

    Each whole round gives the document unchanged; a block choice gives the words of the document that
    lie in chosen blocks, one row per stretch (the whole text where it covers all of it). Documents
    without words are in no block and in no row.
    """
    sized = docs.withColumn("_size", _words())
    shards, quota = quotas(shared_table(sized.select("doc_id", "source", "_size"), "mix-sizes"), seed=seed)
    inner = ["_from", "_to", "_block", "_blocks", "_rounds", "_rest", "_start"]
    placed = _placed(sized, shards, quota, seed).filter("taken > 0").select(*docs.columns, *inner)
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            state = zip(*(b.column(i).to_pylist() for i in range(len(names), len(names) + len(inner))))
            for i, (text, (x, y, block, blocks, rounds, rest, start)) in enumerate(zip(raw_texts(b.column(at)), state)):
                pieces = [text] * rounds
                for lo, hi in stretches(x, y, block, blocks, rest, start):
                    pieces.append(text if hi - lo == y - x else words_between(text, lo, hi))
                rows += [i] * len(pieces)
                texts += pieces
            taken = b.take(pa.array(rows, pa.int64()))
            kind = b.schema.field(at).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.binary()).cast(kind) if i == at else taken.column(i) for i in range(len(names))],
                names=names)

    return placed.mapInArrow(cut, docs.schema)


def stretches(x: int, y: int, block: int, blocks: int, rest: int, start: int) -> list[tuple[int, int]]:
    """Word ranges, relative to x, of [x, y) that lie in chosen blocks; neighbours are joined."""
    out: list[tuple[int, int]] = []
    for i in range(x // block, -(-y // block) if rest else x // block):
        if ((i + 1) * rest + start) // blocks > (i * rest + start) // blocks:
            lo, hi = max(x, i * block) - x, min(y, (i + 1) * block) - x
            if out and out[-1][1] == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def words_between(text: bytes, lo: int, hi: int) -> bytes:
    """The text from its word ``lo`` to before its word ``hi``, as written."""
    import re
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)][lo:hi]
    return text[spans[0][0]:spans[-1][1]] if spans else b""


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_counts(read(spark, sf_dir, "documents"))
