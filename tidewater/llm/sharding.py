"""Sharding by histogram sort.

Rows get the key (hash of the text, hash of the id), so equal texts lie together. Splitters
for equal bytes are found by counting: each round deals probes evenly over every splitter's
open key interval, counts the exact bytes below each probe over all partitions, and narrows
the interval, until the bytes below a probe meet the tolerance. An interval that has shrunk to
one text hash is refined by the second key, so that a large group of equal texts can be
split; a smaller one stays whole. Then the rows move once, to shards in key order, each in as many
tasks as its bytes ask for; the rows of a shard in each task, counted on what was written, give the
slots.

Memory: the driver holds the probes and splitters between shards, at every size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_of, read, sheltered, shared_table

SHARDS = 24
TASK_BYTES = 64 << 20      # bytes that one task sorts and numbers, about
TASKS = 1 << 16            # such tasks at most (beyond that they sort more), which bounds the broadcast offsets
PROBES = 64                # probes per open splitter and round
TOLERANCE = 0.01           # of a shard's bytes, left or right of a splitter's target
SPAN = 1 << 64


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "_size": (F.octet_length(text) + F.lit(8)).cast("long"),
        "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), F.col("doc_id"), text)})


def _flip(keys: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys as unsigned ones of the same order."""
    return keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _unsigned(column: pa.Array) -> np.ndarray:
    return _flip(column.to_numpy(zero_copy_only=False))


def _below(keyed: DataFrame, probes: dict[int | None, list[int]]) -> dict[tuple[int | None, int], tuple[int, int]]:
    """Exact bytes and rows below each probe, counted over all partitions.

    ``probes``: sorted probes of the first key under None; of the second key under a first key.
    The end of the key space (SPAN) is always among the answers.
    """
    pieces = [(p, np.array(v, np.uint64)) for p, v in probes.items()]

    def count(batches):
        sums = [np.zeros((len(v) + 1, 2), np.int64) for _, v in pieces]
        for b in batches:
            k1, k2 = _unsigned(b.column(0)), _unsigned(b.column(1))
            size = b.column(2).to_numpy()
            for total, (prefix, at) in zip(sums, pieces):
                own = slice(None) if prefix is None else k1 == np.uint64(prefix)
                slot = np.searchsorted(at, (k1 if prefix is None else k2)[own], side="right")
                np.add.at(total[:, 0], slot, size[own])
                np.add.at(total[:, 1], slot, 1)
        every = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(t), i, np.int32) for i, t in enumerate(sums)])),
             pa.array(np.concatenate([np.arange(len(t), dtype=np.int32) for t in sums])),
             pa.array(np.ascontiguousarray(every[:, 0])), pa.array(np.ascontiguousarray(every[:, 1]))],
            names=["piece", "slot", "bytes", "n"])

    rows = (keyed.select("_k1", "_k2", "_size").mapInArrow(count, "piece int, slot int, bytes long, n long")
            .groupBy("piece", "slot").agg(F.sum("bytes"), F.sum("n")).collect())
    counted = {(p, s): (x, n) for p, s, x, n in rows}
    out = {}
    for i, (prefix, at) in enumerate(pieces):
        size = n = 0
        for j, key in enumerate([*at.tolist(), SPAN]):
            more = counted.get((i, j), (0, 0))
            size, n = size + more[0], n + more[1]
            out[prefix, key] = (size, n)
    return out


def find_splitters(keyed: DataFrame, shards: int, total: int) -> list[tuple[int, int]]:
    """Keys (first, second) at which the shards begin, but for the first.

    A splitter meets TOLERANCE of a shard's bytes; one whose interval is down to a single row takes the
    nearer side of that row.
    """
    slack = max(1, int(total / shards * TOLERANCE))
    found: dict[int, tuple[int, int]] = {}
    # splitter -> prefix (None while on the first key), open interval [low, high), bytes below the prefix
    state = {i: (None, 0, SPAN, 0) for i in range(1, shards)}
    while state:
        tries = {i: [*range(low, high, max(1, -(-(high - low) // PROBES))), high]
                 for i, (_, low, high, _) in state.items()}
        probes: dict[int | None, set[int]] = {}
        for i, keys in tries.items():
            probes.setdefault(state[i][0], set()).update(k for k in keys if k < SPAN)
        below = _below(keyed, {p: sorted(v) for p, v in probes.items()})
        for i, keys in tries.items():
            prefix, _, _, before = state.pop(i)
            want = total * i // shards - before
            amounts = [below[prefix, k][0] for k in keys]
            j = max(x for x in range(len(keys) - 1) if x == 0 or amounts[x] <= want)
            best = j if keys[j + 1] == SPAN or want - amounts[j] <= amounts[j + 1] - want else j + 1
            single = below[prefix, keys[j + 1]][1] - below[prefix, keys[j]][1] <= 1
            if abs(amounts[best] - want) <= slack or single or (prefix is not None and keys[j + 1] - keys[j] == 1):
                found[i] = (keys[best], 0) if prefix is None else (prefix, keys[best])
            elif keys[j + 1] - keys[j] > 1:
                state[i] = (prefix, keys[j], keys[j + 1], before)
            else:  # one text hash holds the target: go on by the second key
                state[i] = (keys[j], 0, SPAN, amounts[j])
    return [found[i] for i in sorted(found)]


def shard_splitters(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """The narrow keyed table, the splitters between shards, and the bytes of all rows."""
    keyed = shared_table(_keyed(docs.select("doc_id", "text")).select(
        "doc_id", "_size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "_k1", "_k2"), "shard-keys")
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    return keyed, find_splitters(keyed, shards, total) if total else [], total


def place(keyed: DataFrame, splitters: list[tuple[int, int]], total: int) -> DataFrame:
    """``keyed`` with shard and slot: one exchange to tasks of consecutive keys, written with each row's place in
    its task; a shard's rows in the tasks before give the offset (one number per task and shard)."""
    first = np.array([a for a, _ in splitters], np.uint64)
    second = np.array([b for _, b in splitters], np.uint64)
    inner = np.unique(first[second > 0])  # texts split over shards: few

    @F.pandas_udf("int")
    def shard_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = _flip(k1.to_numpy()), _flip(k2.to_numpy())
        out = np.searchsorted(first, a, side="right").astype(np.int32)
        for key in inner:
            own = a == key
            lo, hi = np.searchsorted(first, key, side="left"), np.searchsorted(first, key, side="right")
            out[own] = lo + np.searchsorted(second[lo:hi], b[own], side="right")
        return pd.Series(out)

    order = ["shard", "_k1", "_k2", "doc_id"]
    tasks = max(len(splitters) + 1, min(TASKS, math.ceil(total / TASK_BYTES)))
    # written, so that the counts and the slots see the same places; the number's high bits tell the task
    placed = shared_table(keyed.withColumn("shard", shard_of("_k1", "_k2")).repartitionByRange(tasks, *order)
                          .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "shard-rows")
    task = F.shiftright("_at", 33).alias("_task")
    offsets = (placed.groupBy("shard", task).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
               .withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_task")) - F.col("_n"))
               .select(F.col("shard").alias("_shard"), "_task", (F.col("_before") - F.col("_from")).alias("_shift")))
    return (placed.join(F.broadcast(offsets), (F.col("shard") == F.col("_shard")) & (F.shiftright("_at", 33) == F.col("_task")))
            .withColumn("slot", F.col("_at") + F.col("_shift"))
            .drop("_at", "_shard", "_task", "_shift", "_k1", "_k2"))


@sheltered("_size", "_k1", "_k2", "_at", "_shard", "_task", "_shift")
def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Size of a row: UTF-8 bytes of its text (null: none) plus 8; shards differ by about the
    tolerance. Rows of equal text and id stay together; an empty table gives an empty result;
    extra columns are kept, those named shard or slot are replaced. The texts move once.
    """
    _, splitters, total = shard_splitters(docs, shards)
    return place(_keyed(clear_of(docs, "shard", "slot")), splitters, total).drop("_size")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``bytes``."""
    return (place(*shard_splitters(read(spark, sf_dir, "documents")))
            .select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
