"""First-come stock reservation (RSV-1).

Each request (key, qty) is decided in order per key: if the available stock
(on hand - reserved) is at least qty, the stock is reserved and the result
is 0; otherwise nothing changes and the result is 1. A rejected request uses
nothing, so this is an ordered fold, not a running sum. Missing inventory
means available 0 (so qty <= 0 succeeds, qty > 0 fails, and nothing changes: a
release without a stock row makes no stock); a NULL qty fails; a negative qty
releases stock.

Ordinary keys are decided by a streaming fold: hash-partitioned by key, sorted, and walked with one running
number per key. Keys with more than ``key_limit`` requests (counted by partial aggregation) take a parallel
prefix scan over transfer functions (``transfer.py``) instead, exact for any mix of requests and releases:

1. Their requests are range-partitioned on (key, order), so a hot key is spread over many tasks, and cut into
   *chunks* of at most ``chunk_rows`` requests of one key.
2. One row per chunk (sum, least prefix sum, greatest request) gives, by windows over those rows, bounds on the
   stock each chunk can start with.
3. Every chunk becomes the piecewise map from starting to ending stock over its bounds. The ending stocks it
   allows (a few intervals, as different stocks soon fall together) are the next chunk's starting stocks.
4. Over those, every chunk's map is taken again, now of a few pieces; the maps of a key are composed in order
   with one running number, which gives each chunk its true starting stock.
5. All chunks are walked at once, each from its own stock.

No chunk waits for another's walk, and no task walks a key: the number of passes is fixed. The requests are
checkpointed to the shared checkpoint folder after step 1 (lineage cut, chunks fixed, executor loss safe). The driver
holds a few numbers per chunk.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .joins import broadcast_if_small
from .transfer import image, transfer

RESULT_OK = 0
RESULT_INSUFFICIENT = 1


def _available(inventory: DataFrame, key: list[str], on_hand: str, reserved: str) -> DataFrame:
    return inventory.select(*key, (F.col(on_hand) - F.col(reserved)).cast("long").alias("_a0"))


def reserve(inventory: DataFrame, requests: DataFrame, key: list[str] | str, order: list[str] | str,
            qty: str = "qty", request_id: str = "request_id", on_hand: str = "qty_on_hand",
            reserved: str = "qty_reserved", key_limit: int = 1_000_000, chunk_rows: int = 200_000,
            partitions: int | None = None) -> DataFrame:
    """Decide every request; returns the request columns plus ``result``.

    ``order`` (plus ``request_id`` as tie-break) is the arrival order.
    Keys with at most ``key_limit`` requests (counted per key) are decided by the ordered walk: one hash
    shuffle on the key, a sort, and one running number per key. Keys above it are hot: their requests are cut into
    chunks of at most ``chunk_rows`` and scanned in parallel, so no task ever walks a key of more requests than
    ``key_limit``.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    spark = requests.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base_cols = list(dict.fromkeys([request_id, *key, *order, qty]))
    inv = broadcast_if_small(_available(inventory, key, on_hand, reserved))
    req = (requests.select(*base_cols).join(inv, key, "left")
           .select(*base_cols, F.col("_a0").alias("_r")))
    seq = list(dict.fromkeys([*order, request_id]))
    # without a stock row (a NULL key has none) a request stands alone against 0 available
    # and changes nothing; so does one without a quantity, which fails
    alone = F.col("_r").isNull() | F.col(qty).isNull()
    decided: list[DataFrame] = [
        req.filter(alone).select(*base_cols, F.when(F.col(qty) <= 0, F.lit(RESULT_OK))
                                    .otherwise(F.lit(RESULT_INSUFFICIENT)).cast("int").alias("result"))]
    open_rows = req.filter(~alone)
    hot = open_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > key_limit)
    checkpoint_dir(spark)
    hot = hot.checkpoint(eager=True)  # counted once: one row per hot key
    n_hot = hot.agg(F.sum("_n")).first()[0]
    if n_hot:
        hot_keys = broadcast_if_small(hot.select(*key))
        parts = max(n, -(-n_hot // chunk_rows))
        decided.append(_scan_chunks(open_rows.join(hot_keys, key, "left_semi"), key, seq, qty, parts, chunk_rows)
                       .select(*base_cols, "result"))
        open_rows = open_rows.join(hot_keys, key, "left_anti")
    decided.append(_serial_fold(open_rows, key, seq, qty, n).select(*base_cols, "result"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def _chunks(batches, width: int, limit: int):
    """(key, (partition, number), starting stock, quantities) of the chunks of a sorted partition: runs of one key, of at
    most ``limit`` requests. Columns: the key (``width`` of them), the quantity, the starting stock, the partition."""
    cur, number, held, stock, pid = None, -1, [], 0, 0
    for pdf in batches:
        cols = [pdf[c].tolist() for c in pdf.columns]
        pid = cols[width + 2][0] if len(pdf) else pid
        for k, q, r in zip(zip(*cols[:width]), cols[width], cols[width + 1]):
            if k != cur or len(held) == limit:
                if held:
                    yield cur, (pid, number), stock, held
                cur, number, held, stock = k, number + 1, [], r
            held.append(q)
    if held:
        yield cur, (pid, number), stock, held


def _chunk_job(ranged: DataFrame, key: list[str], qty: str, limit: int, columns: str, rows_of) -> DataFrame:
    """A table of (key, _pid, _no, ``columns``): ``rows_of((_pid, _no), stock, quantities)`` for every chunk."""
    schema = T.StructType([*[ranged.schema[k] for k in key], T.StructField("_pid", T.IntegerType()),
                           T.StructField("_no", T.LongType()), *T.StructType.fromDDL(columns).fields])

    def run(batches):
        import pandas as pd
        for k, at, stock, held in _chunks(batches, len(key), limit):
            yield pd.DataFrame([(*k, *at, *x) for x in rows_of(at, stock, held)], columns=schema.names)

    return ranged.select(*key, qty, "_r", "_pid").mapInPandas(run, schema)


def _scan_chunks(rows: DataFrame, key: list[str], seq: list[str], qty: str, parts: int, limit: int) -> DataFrame:
    """Steps 1 to 5 of the parallel scan; returns the rows with their result."""
    spark = rows.sparkSession
    ranged = (rows.repartitionByRange(parts, *key, *seq).sortWithinPartitions(*key, *seq)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    totals = _chunk_job(ranged, key, qty, limit, "total long, low long, most long, a0 long", lambda _, stock, q: [
        (-sum(q), min(accumulate(-x for x in q)), max(q), stock)])
    # bounds by prefix sums X: a stock below the key's greatest request q* stays below it, one above falls by what is
    # asked, so it is at most max(v + x, q*) after each step; likewise at least max(l + x, 0)
    every = Window.partitionBy(*key)
    before = every.orderBy("_pid", "_no").rowsBetween(Window.unboundedPreceding, -1)
    scanned = (totals.withColumn("x", F.coalesce(F.sum("total").over(before), F.lit(0)))
               .withColumn("m", F.min(F.col("x") + F.col("low")).over(before))
               .withColumn("top", F.greatest(F.lit(0), F.max("most").over(every))))
    bounds = scanned.select("_pid", "_no", F.when(F.col("m").isNull(), F.col("a0")).when(F.col("a0") < 0, F.col("a0")).otherwise(
        F.col("x") + F.greatest("a0", -F.col("m"))).alias("lo"), F.when(F.col("m").isNull(), F.col("a0")).otherwise(
        F.col("x") + F.greatest(F.greatest("a0", "top"), F.col("top") - F.col("m"))).alias("hi"))
    domains = spark.sparkContext.broadcast({(r[0], r[1]): [(r.lo, r.hi)] for r in bounds.collect()})
    images = _chunk_job(ranged, key, qty, limit, "spans array<struct<lo: long, hi: long>>", lambda at, stock, q: [
        ([{"lo": lo, "hi": hi} for lo, hi in image(transfer(q, domains.value[at]))],)])
    previous = (images.withColumn("spans", F.lag("spans").over(every.orderBy("_pid", "_no")))
                .filter(F.col("spans").isNotNull()).select("_pid", "_no", "spans"))
    starts = spark.sparkContext.broadcast({(r[0], r[1]): [(x.lo, x.hi) for x in r.spans] for r in previous.collect()})
    maps = _chunk_job(ranged, key, qty, limit, "lo long, hi long, shift long", lambda at, stock, q: transfer(
        q, starts.value.get(at, [(stock, stock)])))
    known = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in _compose(maps, key, parts).collect()})
    schema = T.StructType([*rows.schema.fields, T.StructField("result", T.IntegerType())])
    width, names = len(key), rows.columns
    order = [*key, qty, "_pid"]

    def walk(batches):
        import pandas as pd
        cur, number, left, stock = None, -1, 0, 0
        for pdf in batches:
            cols = [pdf[c].tolist() for c in order]
            pid = cols[-1][0] if len(pdf) else 0
            result = []
            for k, q in zip(zip(*cols[:width]), cols[width]):
                if k != cur or not left:
                    cur, number, left = k, number + 1, limit
                    stock = known.value[pid, number]  # (the task's own number is another one in a union)
                left -= 1
                if stock >= q:
                    stock -= q
                    result.append(RESULT_OK)
                else:
                    result.append(RESULT_INSUFFICIENT)
            yield pdf[names].assign(result=pd.Series(result, index=pdf.index, dtype="int32"))

    return ranged.mapInPandas(walk, schema)


def _compose(maps: DataFrame, key: list[str], parts: int) -> DataFrame:
    """(_pid, _no, start): each chunk's true starting stock, by the maps of the chunks before it."""
    def compose(batches):
        import pandas as pd
        cur, at, stock, after = None, None, 0, 0
        for pdf in batches:
            out = []
            for *k, pid, number, lo, hi, shift in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if k != cur:           # a key's first chunk: its map has the one true starting stock
                    cur, at, stock, after = k, None, lo, lo
                if (pid, number) != at:
                    at, stock = (pid, number), after
                    out.append((pid, number, stock))
                if lo <= stock <= hi:
                    after = stock + shift
            yield pd.DataFrame(out, columns=["_pid", "_no", "start"])

    return (maps.repartition(parts, *key).sortWithinPartitions(*key, "_pid", "_no", "lo")
            .mapInPandas(compose, "_pid int, _no long, start long"))


def _serial_fold(rows: DataFrame, key: list[str], seq: list[str], qty: str, n: int) -> DataFrame:
    """Ordered fold per key (each key holds a bounded number of rows), streamed
    batch by batch with one running number per key."""
    out_schema = T.StructType(list(rows.schema.fields) + [T.StructField("result", T.IntegerType())])
    names = rows.columns
    key_idx = [names.index(k) for k in key]
    q_idx, r_idx = names.index(qty), names.index("_r")

    def walk(batches):
        import pandas as pd
        cur, avail = object(), 0
        for pdf in batches:
            cols = [pdf[c].tolist() for c in names]
            keys = list(zip(*[cols[i] for i in key_idx]))
            q, r = cols[q_idx], cols[r_idx]
            res = [0] * len(q)
            for i in range(len(q)):
                if keys[i] != cur:
                    cur, avail = keys[i], r[i]
                if avail >= q[i]:
                    avail -= q[i]
                else:
                    res[i] = RESULT_INSUFFICIENT
            pdf = pdf.copy()
            pdf["result"] = pd.Series(res, index=pdf.index, dtype="int32")
            yield pdf

    return (rows.repartition(n, *key).sortWithinPartitions(*key, *seq)
            .mapInPandas(walk, out_schema))


def reserved_totals(inventory: DataFrame, results: DataFrame, key: list[str] | str, qty: str = "qty",
                    reserved: str = "qty_reserved") -> DataFrame:
    """Inventory after the accepted requests: reserved += sum of accepted qty.

    Keys without an inventory row are not created (the update finds no row).
    """
    key = [key] if isinstance(key, str) else list(key)
    taken = (results.filter(F.col("result") == RESULT_OK)
             .groupBy(*key).agg(F.sum(qty).alias("_taken")))
    return (inventory.join(taken, key, "left")
            .withColumn(reserved, (F.col(reserved) + F.coalesce("_taken", F.lit(0))).cast(
                inventory.schema[reserved].dataType))
            .drop("_taken"))
