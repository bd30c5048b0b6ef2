"""Alarms and reservations as keyed streaming state (OBS-1 to OBS-3, RSV-2).

``alarm_records`` keeps per metric the open periods, the last few periods' verdicts and the alarm's state. A period
closes when the watermark passes its end, by a timer if no point comes, so missing periods are seen too. A
point of a closed period is not dropped: it comes out as a ``late`` record, and ``merged_periods`` adds late records to the
periods they belong to. Points are added up per Arrow batch before they are shuffled, so that a busy metric sends its state
a few rows per task. Sums are exact (integers of ``scale`` places).

Spark drops rows behind the watermark before a keyed operator sees them. So data rows carry no event time, and a
separate row per batch (a *beat*) carries the batch's greatest one: beats move the watermark, data always arrive.

``reserve_keyed`` keeps the stock left per key, many keys to a state. Both append their records exactly once to a file sink
(``append_records``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import _COMPARE, ALARM, INSUFFICIENT, OK, _is_ntz, _slot, _slot_start, epoch_micros
from ..operators.reserve import RESULT_INSUFFICIENT, RESULT_OK

KEY_BUCKETS = 1024   # states that the keys of reservations are dealt to
PARTIAL = ["n", "m", "total", "low", "high"]   # points, those with a value, and the values' sum, least and greatest


def _partials(metrics: DataFrame, ts: str, value: str, dims: list[str], period_s: int, scale: int) -> DataFrame:
    """(dims, slot, partial, e): points added up per Arrow batch, and a beat per batch (n = 0, e its greatest time)."""
    ntz = _is_ntz(metrics, ts)
    unscaled = (F.col(value).cast(T.DecimalType(18, scale)) * (10 ** scale)).cast("long")
    points = metrics.filter(F.col(ts).isNotNull()).select(
        *dims, _slot(F.col(ts), period_s, ntz).alias("slot"), unscaled.alias("v"), epoch_micros(F.col(ts), ntz).alias("us"))
    schema = T.StructType([*[points.schema[d] for d in dims], T.StructField("slot", T.LongType()),
                           *[T.StructField(c, T.DecimalType(38, 0) if c in PARTIAL[2:] else T.LongType()) for c in PARTIAL],
                           T.StructField("us", T.LongType())])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for at, own in pdf.groupby([*dims, "slot"], dropna=False, sort=False):
                v = [int(x) for x in own["v"].dropna()]
                out.append((*[None if pd.isna(x) else x for x in at], len(own), len(v), Decimal(sum(v)),
                            Decimal(min(v)) if v else None, Decimal(max(v)) if v else None, None))
            out.append((*out[0][:len(dims)], 0, 0, 0, Decimal(0), None, None, int(pdf["us"].max())))
            yield pd.DataFrame(out, columns=schema.names).astype({"us": "Int64"})

    return points.mapInPandas(add_up, schema).withColumn("e", F.timestamp_micros("us")).drop("us")


class _Series:
    """The state of one metric: what is open, what was seen last, and the alarm."""

    def __init__(self, text: str | None):
        data = json.loads(text) if text else {"closed": None, "first": None, "recent": [], "state": INSUFFICIENT, "open": {}}
        self.closed, self.first, self.recent, self.state = data["closed"], data["first"], data["recent"], data["state"]
        self.open = {int(s): p for s, p in data["open"].items()}

    def text(self) -> str:
        return json.dumps({"closed": self.closed, "first": self.first, "recent": self.recent, "state": self.state, "open": self.open})

    def add(self, slot: int, partial: list[int | None]) -> None:
        old = self.open.get(slot)
        if old is None:
            self.open[slot] = partial
        else:
            self.open[slot] = [old[0] + partial[0], old[1] + partial[1], old[2] + partial[2],
                               min((x for x in (old[3], partial[3]) if x is not None), default=None),
                               max((x for x in (old[4], partial[4]) if x is not None), default=None)]


def measured(statistic: str, partial: list[int | None], scale: int) -> Decimal | None:
    """The statistic of a period from its partial sums, as Spark computes it of DECIMAL(18, scale)."""
    n, m, total, low, high = partial
    if statistic == "SampleCount":
        return Decimal(m)
    if not m:
        return None
    if statistic == "Average":
        return (Decimal(total).scaleb(-scale) / m).quantize(Decimal(1).scaleb(-scale - 4), ROUND_HALF_UP)
    return Decimal({"Sum": total, "Minimum": low, "Maximum": high}[statistic]).scaleb(-scale)


def alarm_records(metrics: DataFrame, ts: str, value: str, dims: list[str], period_s: int, statistic: str, threshold,
                  comparison: str, evaluation_periods: int, missing: str = "ignore", watermark: str = "10 minutes",
                  scale: int = 2) -> DataFrame:
    """A stream of records (dims, kind, period_start, n, m, total, low, high, state, previous_state).

    ``period``: a closed period with points, and the alarm's state at it and before it. ``missing``: a closed period without
    points at which the state changed. ``late``: points of a period that was closed before they came; they change
    no state. Closed periods, their order and their states are those of ``period_stat`` and ``alarm_states`` over the
    points that were not late, however the points are dealt to micro-batches. Points without a time are left out, as
    there. State per metric: the periods that the watermark has not passed and ``evaluation_periods`` verdicts.
    """
    if missing not in ("ignore", "breaching"):
        raise ValueError("missing must be 'ignore' or 'breaching'")
    span, need, breaches = period_s * 1000, int(evaluation_periods), _COMPARE[comparison]
    limit = Decimal(str(threshold))
    rows = _partials(metrics, ts, value, dims, period_s, scale).withWatermark("e", watermark)
    schema = T.StructType([*[rows.schema[d] for d in dims], T.StructField("kind", T.StringType()), T.StructField("slot", T.LongType()),
                           *[rows.schema[c] for c in PARTIAL], T.StructField("state", T.StringType()),
                           T.StructField("previous_state", T.StringType())])

    def verdict(series: _Series, slot: int) -> str:
        series.recent = [r for r in series.recent if r[0] > slot - need]
        got, hit = len(series.recent), sum(b for _, b in series.recent)
        if missing == "ignore":
            return INSUFFICIENT if got < need else ALARM if hit == need else OK
        slots = min(need, slot - series.first + 1)
        return INSUFFICIENT if slots < need else ALARM if hit + slots - got == need else OK

    def close(series: _Series, to: int) -> Iterator[tuple]:
        """Closes the periods up to ``to``; of those without points only the first few can change the state."""
        for slot in [*sorted(s for s in series.open if s <= to), None]:
            if series.first is not None:
                gap = series.closed + 1
                for empty in range(gap, min(to + 1 if slot is None else slot, gap + need)):
                    before, series.state = series.state, verdict(series, empty)
                    if before != series.state:
                        yield ("missing", empty, 0, 0, 0, None, None, series.state, before)
            if slot is None:
                break
            partial = series.open.pop(slot)
            series.first = slot if series.first is None else series.first
            v = measured(statistic, partial, scale)
            series.recent.append([slot, bool(v is not None and breaches(v, limit))])
            before, series.state = series.state, verdict(series, slot)
            series.closed = slot
            yield ("period", slot, *partial, series.state, before)
        series.closed = to if series.closed is None else max(series.closed, to)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        series = _Series(state.get[0] if state.exists else None)
        out = list(close(series, mark // span - 1 if mark > 0 else -(1 << 50)))  # 0: no watermark yet
        for pdf in batches:
            for row in pdf[["slot", *PARTIAL]].itertuples(index=False):
                if not row.n:
                    continue
                slot, partial = int(row.slot), [int(row.n), int(row.m), *[None if pd.isna(x) else int(x) for x in row[3:]]]
                if slot <= series.closed:
                    out.append(("late", slot, *partial, None, None))
                else:
                    series.add(slot, partial)
        # the next period with points, or one that may yet change the state
        until = min(series.open, default=None)
        if series.recent and series.recent[-1][0] + need > series.closed:
            until = series.closed + 1
        state.update((series.text(),))
        if until is not None:
            state.setTimeoutTimestamp(max(mark + 1, (until + 1) * span))
        if out:
            pdf = pd.DataFrame([(*key, *x) for x in out], columns=schema.names)
            for c in PARTIAL[2:]:
                pdf[c] = pd.Series([None if pd.isna(x) else Decimal(int(x)) for x in pdf[c]], dtype=object)
            yield pdf

    found = rows.groupBy(*dims).applyInPandasWithState(step, schema, "series string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*dims, "kind", _slot_start(F.col("slot"), period_s, _is_ntz(metrics, ts)).alias("period_start"),
                        *PARTIAL, "state", "previous_state")


def append_records(records: DataFrame, path: str, checkpoint_location: str, available_now: bool = True,
                   processing_time: str = "1 minute"):
    """Append a record stream to Parquet files, each record once; a bounded run is waited for."""
    writer = records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint_location)
    q = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)).start()
    if available_now:
        q.awaitTermination()
    return q


def merged_periods(records: DataFrame, dims: list[str], statistic: str, scale: int = 2) -> DataFrame:
    """(dims, period_start, value, samples, late_samples): closed periods with the late points that belong to them."""
    own = records.filter(F.col("kind").isin("period", "late"))
    out = own.groupBy(*dims, "period_start").agg(
        F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(F.col("kind") == "late", F.col("n"))), F.lit(0)).alias("late_samples"),
        F.sum("m").alias("m"), F.sum("total").cast("decimal(38,0)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(T.DecimalType(scale + 1, scale))
    raw = {"Sum": "total", "Minimum": "low", "Maximum": "high", "Average": "total"}
    if statistic == "SampleCount":
        value = F.col("m").cast("decimal(20,0)")
    else:
        value = F.when(F.col("m") > 0, F.col(raw[statistic]).cast("decimal(30,0)") * unit)
        value = value / F.col("m").cast("decimal(20,0)") if statistic == "Average" else value
    return out.select(*dims, "period_start", value.alias("value"), "samples", "late_samples")


def notifications(records: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, period_start, previous_state, state): into ALARM, and from ALARM back to OK (OBS-3)."""
    changed = F.col("state") != F.col("previous_state")
    told = (F.col("state") == ALARM) | ((F.col("state") == OK) & (F.col("previous_state") == ALARM))
    return records.filter(changed & told).select(*dims, "period_start", "previous_state", "state")


def _identity(columns: list[Column], kinds: list[T.DataType]) -> Column:
    """A key as one string, another one for each key."""
    texts = [F.hex(c) if isinstance(k, T.BinaryType) else c.cast("string") for c, k in zip(columns, kinds)]
    return texts[0] if len(texts) == 1 else F.to_json(F.struct(*[t.alias(f"k{i}") for i, t in enumerate(texts)]))


def reserve_keyed(inventory: DataFrame, requests: DataFrame, key: list[str] | str, order: list[str] | str, qty: str = "qty",
                  request_id: str = "request_id", on_hand: str = "qty_on_hand", reserved: str = "qty_reserved",
                  buckets: int = KEY_BUCKETS) -> DataFrame:
    """A stream of decided requests (their columns, and result), with the stock left per key as state.

    A key starts with what ``inventory`` has when its first request comes. Requests of a micro-batch are decided in order,
    after those of earlier batches; a request without a stock row or a quantity stands alone and keeps no state.
    Keys are dealt to ``buckets``, and a state holds the stock left of all keys of a bucket, as a call costs milliseconds and a
    request in it microseconds; a micro-batch rewrites the states of the buckets it has requests of. One task holds
    the requests of one bucket in one micro-batch (order, id and quantity). For keys with more of them than
    that, use ``reserve_stream``, which scans hot keys in parallel. A checkpoint belongs to its number of buckets.
    """
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    columns = list(dict.fromkeys([request_id, *key, *order, qty]))
    sequence = list(dict.fromkeys([*order, request_id]))
    # the identity is the stock row's: it is one whatever equal forms the requests have their key in
    stock = inventory.select(*key, (F.col(on_hand) - F.col(reserved)).cast("long").alias("_a0"),
                             _identity([F.col(k) for k in key], [inventory.schema[k].dataType for k in key]).alias("_key"))
    rows = requests.select(*columns).join(stock, key, "left").select(*columns, "_a0", "_key")
    alone = F.col("_a0").isNull() | F.col(qty).isNull()
    by_itself = F.when(F.col(qty) <= 0, F.lit(RESULT_OK)).otherwise(F.lit(RESULT_INSUFFICIENT)).cast("int")
    # pandas has integers with nulls as doubles: nulls travel beside them
    whole = [c for c in sequence if isinstance(rows.schema[c].dataType, T.IntegralType)]
    null_of = {c: f"_null{i}" for i, c in enumerate(whole)}
    sent = (rows.filter(~alone).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
            .withColumns({n: F.col(c).isNull() for c, n in null_of.items()})
            .withColumns({c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in whole}))
    out = [*columns, *null_of.values()]
    schema = T.StructType([*[sent.schema[c] for c in out], T.StructField("result", T.IntegerType())])
    by = [x for c in sequence for x in ([null_of[c], c] if c in null_of else [c])]

    def decide(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches), ignore_index=True).sort_values(by)
        left = dict(zip(*state.get)) if state.exists else {}
        results = []
        for k, first, q in zip(own["_key"].tolist(), own["_a0"].astype("int64").tolist(), own[qty].astype("int64").tolist()):
            have = left.get(k, first)
            results.append(RESULT_OK if have >= q else RESULT_INSUFFICIENT)
            left[k] = have - q if have >= q else have
        state.update((list(left), list(left.values())))
        yield own[out].assign(result=pd.Series(results, index=own.index, dtype="int32"))

    held = sent.groupBy("_bucket").applyInPandasWithState(decide, schema, "keys array<string>, available array<long>", "append",
                                                          GroupStateTimeout.NoTimeout)
    held = held.select(*[F.when(~F.col(null_of[c]), F.col(c)).alias(c) if c in null_of else c for c in columns], "result")
    return held.unionByName(rows.filter(alone).select(*columns, by_itself.alias("result")))
