"""Metric monitoring (OBS-1..OBS-5), re-aimed from managed alarms to
DataFrame operators that work the same on a batch and on a stream.

Alarm evaluation is slot-based: a period of length ``period_s`` is a slot;
a rule looks at the last ``n`` slots ending at each slot. With
``missing="ignore"`` an empty slot is no datapoint (fewer than ``n``
datapoints -> INSUFFICIENT); with ``missing="breaching"`` every empty slot
after the metric's first datapoint counts as a breaching datapoint.
State: INSUFFICIENT until ``n`` datapoints, ALARM when all ``n`` breach,
else OK.

Evaluation uses no window over a whole metric series: each datapoint is
copied to the ``n`` windows it belongs to (``n`` is a small constant) and
the windows are counted with a grouped aggregate, and transitions join a
slot to the slot before it. Every step is an equi-join or a group-by on
(dimensions, slot), so a busy metric spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, ALARM, INSUFFICIENT = "OK", "ALARM", "INSUFFICIENT"

_COMPARE = {
    "GreaterThanThreshold": lambda v, t: v > t,
    "GreaterThanOrEqualToThreshold": lambda v, t: v >= t,
    "LessThanThreshold": lambda v, t: v < t,
    "LessThanOrEqualToThreshold": lambda v, t: v <= t,
}
_STATS = {
    "Average": F.avg, "Maximum": F.max, "Minimum": F.min, "Sum": F.sum,
    "SampleCount": lambda c: F.count(c),
}


@dataclass(frozen=True)
class AlarmRule:
    name: str
    metric: str
    statistic: str            # Average | Maximum | Minimum | Sum | SampleCount
    period_s: int
    threshold: float
    comparison: str           # GreaterThanThreshold | LessThanThreshold | ...
    evaluation_periods: int


# ---- fixed values: the alarm rules of the source deployment ---------------
ALARM_RULES = [
    AlarmRule("dms-high-cpu", "CPUUtilization", "Average", 300, 80, "GreaterThanThreshold", 2),
    AlarmRule("dms-low-memory", "FreeableMemory", "Average", 300, 524288000, "LessThanThreshold", 2),
    AlarmRule("dms-cdc-latency-high", "CDCLatencySource", "Maximum", 60, 60, "GreaterThanThreshold", 3),
    AlarmRule("dms-cdc-target-latency-high", "CDCLatencyTarget", "Maximum", 60, 60, "GreaterThanThreshold", 3),
    AlarmRule("rds-high-cpu", "CPUUtilization", "Average", 300, 80, "GreaterThanThreshold", 2),
    AlarmRule("rds-low-storage", "FreeStorageSpace", "Average", 300, 10737418240, "LessThanThreshold", 1),
    AlarmRule("rds-high-connections", "DatabaseConnections", "Average", 300, 800, "GreaterThanThreshold", 2),
    AlarmRule("rds-low-memory", "FreeableMemory", "Average", 300, 1073741824, "LessThanThreshold", 2),
    AlarmRule("rds-high-read-latency", "ReadLatency", "Average", 60, 0.02, "GreaterThanThreshold", 3),
    AlarmRule("rds-high-write-latency", "WriteLatency", "Average", 60, 0.05, "GreaterThanThreshold", 3),
]
EVENT_CATEGORIES = ["creation", "deletion", "failure", "configuration change"]
# ---------------------------------------------------------------------------


EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(ts: Column, ntz: bool = True) -> Column:
    """Microseconds since 1970-01-01: of the wall-clock value for
    TIMESTAMP_NTZ (no time zone involved), of the instant for TIMESTAMP."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)
    return F.unix_micros(ts)


def _is_ntz(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.TimestampNTZType)


def _slot(ts: Column, period_s: int, ntz: bool = True) -> Column:
    return F.floor(epoch_micros(ts, ntz) / F.lit(period_s * 1_000_000)).cast("long")


def _slot_start(slot: Column, period_s: int, ntz: bool = True) -> Column:
    if ntz:
        return F.timestamp_add("SECOND", slot * F.lit(period_s), F.expr(EPOCH_NTZ))
    return F.timestamp_seconds(slot * F.lit(period_s))


def period_stats(metrics: DataFrame, ts: str, value: str, dims: list[str], period_s: int,
                 statistics: dict[str, str], exact_scale: int | None = None) -> DataFrame:
    """Several statistics of one metric in one pass: ``statistics`` maps output columns to statistics."""
    v = F.col(value).cast(T.DecimalType(18, exact_scale)) if exact_scale is not None else F.col(value)
    return (metrics.groupBy(*dims, F.window(ts, f"{period_s} seconds").alias("_w"))
            .agg(*[_STATS[s](v).alias(n) for n, s in statistics.items()], F.count(F.lit(1)).cast("long").alias("samples"))
            .select(*dims, F.col("_w.start").alias("period_start"), *statistics, "samples"))


def period_stat(metrics: DataFrame, ts: str, value: str, dims: list[str], period_s: int,
                statistic: str = "Average", exact_scale: int | None = None,
                watermark: str | None = None) -> DataFrame:
    """Tumbling-period statistic per dimension (OBS-1).

    Output: dims, period_start, value, samples. ``exact_scale`` casts the
    metric to DECIMAL first, so sums and means do not depend on the order
    rows are added (identical results on every run). With ``watermark`` the
    same plan runs on a stream in append mode.
    """
    v = F.col(value).cast(T.DecimalType(18, exact_scale)) if exact_scale is not None else F.col(value)
    ntz = isinstance(metrics.schema[ts].dataType, T.TimestampNTZType)
    src = metrics
    if watermark:
        # event-time watermarks need a zoned timestamp: read the wall-clock
        # value as UTC (no session time zone involved) and back again below
        if ntz:
            src = src.withColumn(ts, F.timestamp_micros(epoch_micros(F.col(ts), ntz=True)))
        src = src.withWatermark(ts, watermark)
    agg = _STATS[statistic](v)
    out = (src.groupBy(*dims, F.window(ts, f"{period_s} seconds").alias("_w"))
           .agg(agg.alias("value"), F.count(F.lit(1)).cast("long").alias("samples")))
    start = F.col("_w.start")
    if ntz and watermark:
        start = F.timestamp_add("MICROSECOND", F.unix_micros(start), F.expr(EPOCH_NTZ))
    return out.select(*dims, start.alias("period_start"), "value", "samples")


SPINE_BLOCK = 1024


def _spine(bounds: DataFrame, dims: list[str]) -> DataFrame:
    """Every slot from ``_lo`` to ``_hi``, by blocks: no array holds a whole series."""
    block = bounds.select(*dims, "_lo", "_hi", F.explode(F.sequence(
        F.floor(F.col("_lo") / SPINE_BLOCK), F.floor(F.col("_hi") / SPINE_BLOCK))).alias("_b"))
    first, last = F.col("_b") * SPINE_BLOCK, F.col("_b") * SPINE_BLOCK + (SPINE_BLOCK - 1)
    return block.select(*dims, "_lo", F.explode(F.sequence(F.greatest("_lo", first), F.least("_hi", last))).alias("_slot"))


def alarm_states(stats: DataFrame, dims: list[str], period_s: int, threshold, comparison: str,
                 evaluation_periods: int, missing: str = "ignore", value: str = "value",
                 period_start: str = "period_start") -> DataFrame:
    """State of the rule at every slot from each series' first to last slot (OBS-2)."""
    n = int(evaluation_periods)
    cmp = _COMPARE[comparison]
    ntz = _is_ntz(stats, period_start)
    pts = stats.select(*dims, _slot(F.col(period_start), period_s, ntz).alias("_slot"), F.col(value).alias("value"),
                       cmp(F.col(value), F.lit(threshold)).alias("_breach"))
    bounds = pts.groupBy(*dims).agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"))
    spine = _spine(bounds, dims)
    windows = (pts.select(*dims, "_breach", F.explode(F.sequence(F.col("_slot"), F.col("_slot") + (n - 1))).alias("_slot"))
               .groupBy(*dims, "_slot")
               .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_breach").cast("int")).alias("_b")))
    j = (spine.join(windows, [*dims, "_slot"], "left").join(pts.drop("_breach"), [*dims, "_slot"], "left"))
    got = F.coalesce("_n", F.lit(0))
    brk = F.coalesce("_b", F.lit(0))
    if missing == "ignore":
        state = F.when(got < n, INSUFFICIENT).when(brk == n, ALARM).otherwise(OK)
    elif missing == "breaching":
        slots = F.least(F.lit(n), F.col("_slot") - F.col("_lo") + 1)
        state = (F.when(slots < n, INSUFFICIENT).when(brk + (slots - got) == n, ALARM).otherwise(OK))
    else:
        raise ValueError("missing must be 'ignore' or 'breaching'")
    return j.select(*dims, _slot_start(F.col("_slot"), period_s, ntz).alias("period_start"), "value",
                    state.alias("state"))


def alarm_transitions(states: DataFrame, dims: list[str], period_s: int) -> DataFrame:
    """Transitions that notify: into ALARM, and from ALARM back to OK (OBS-3).

    The first slot of a series counts as coming from INSUFFICIENT.
    """
    ntz = _is_ntz(states, "period_start")
    slot = _slot(F.col("period_start"), period_s, ntz)
    # each state goes to its own slot and, as the previous one, to the next: one pass over the states
    none = F.lit(None).cast("string")
    both = states.select(*dims, F.explode(F.array(
        F.struct(slot.alias("slot"), F.col("period_start"), F.col("state"), none.alias("previous_state")),
        F.struct((slot + 1).alias("slot"), F.lit(None).cast(states.schema["period_start"].dataType).alias("period_start"),
                 none.alias("state"), F.col("state").alias("previous_state")))).alias("_x")).select(*dims, "_x.*")
    j = (both.groupBy(*dims, "slot").agg(*[F.max(c).alias(c) for c in ("period_start", "state", "previous_state")])
         .filter(F.col("state").isNotNull())
         .withColumn("previous_state", F.coalesce("previous_state", F.lit(INSUFFICIENT))))
    notify = (((F.col("state") == ALARM) & (F.col("previous_state") != ALARM))
              | ((F.col("state") == OK) & (F.col("previous_state") == ALARM)))
    return j.filter(notify).select(*dims, "period_start", "previous_state", "state")


def filter_events(events: DataFrame, categories: list[str], category: str = "category",
                  source_ids: list | None = None, source: str | None = None) -> DataFrame:
    """Events of the subscribed categories (and sources) (OBS-4)."""
    cond = F.col(category).isin(list(categories))
    if source_ids is not None and source is not None:
        cond = cond & F.col(source).isin(list(source_ids))
    return events.filter(cond)


# ---- status telemetry rollup (OBS-5) ---------------------------------------
TUNNEL_SCHEMA = T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("status", T.StringType()), T.StructField("ip", T.StringType()),
    T.StructField("reason", T.StringType())])))
PEER_SCHEMA = T.StructType([T.StructField("result", T.StructType([T.StructField("bgpPeerStatus", T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("state", T.StringType()),
                  T.StructField("status", T.StringType()), T.StructField("numLearnedRoutes", T.LongType()),
                  T.StructField("advertisedRoutes", T.ArrayType(T.StringType()))])))]))])


REQUIRED_UP, REQUIRED_PEERS = 2, 4


def tunnel_rollup(df: DataFrame, json_col: str, required_up: int = REQUIRED_UP) -> DataFrame:
    """Nested lists of tunnel endpoints: how many are UP, and is that enough.

    Unparseable JSON counts as no endpoint (0 UP), like the shell fallback.
    """
    flat = F.flatten(F.coalesce(F.from_json(json_col, TUNNEL_SCHEMA), F.array().cast(TUNNEL_SCHEMA)))
    up = F.size(F.filter(flat, lambda t: t["status"] == "UP"))
    return df.withColumn("endpoints", F.size(flat)).withColumn("up", up) \
        .withColumn("ready", F.col("up") >= required_up)


def peer_rollup(df: DataFrame, json_col: str, required: int = REQUIRED_PEERS) -> DataFrame:
    """Routing peers: count of peers both UP and ESTABLISHED, peer total, and
    the total number of advertised routes; missing keys default to empty."""
    peers = F.coalesce(F.from_json(json_col, PEER_SCHEMA)["result"]["bgpPeerStatus"],
                       F.array().cast(PEER_SCHEMA["result"].dataType["bgpPeerStatus"].dataType))
    ok = F.size(F.filter(peers, lambda p: (p["status"] == "UP") & (p["state"] == "ESTABLISHED")))
    # size(NULL) is -1 when ANSI mode is off, so test for NULL explicitly
    routes = F.aggregate(peers, F.lit(0).cast("long"), lambda acc, p: acc + F.when(
        p["advertisedRoutes"].isNull(), F.lit(0)).otherwise(F.size(p["advertisedRoutes"])).cast("long"))
    return (df.withColumn("peers", F.size(peers)).withColumn("established", ok)
            .withColumn("advertised_routes", routes).withColumn("ready", F.col("established") >= required))


def evaluate_rule(metrics: DataFrame, rule: AlarmRule, ts: str = "ts", value: str = "value",
                  dims: list[str] | None = None, metric_col: str | None = "metric_name",
                  missing: str = "ignore") -> DataFrame:
    """States of one alarm rule over raw metric points: the rule's statistic
    per period, then its threshold over ``evaluation_periods`` periods."""
    dims = list(dims or [])
    pts = metrics.filter(F.col(metric_col) == rule.metric) if metric_col and metric_col in metrics.columns \
        else metrics
    stats = period_stat(pts, ts, value, dims, rule.period_s, rule.statistic)
    return alarm_states(stats, dims, rule.period_s, rule.threshold, rule.comparison, rule.evaluation_periods,
                        missing=missing).withColumn("alarm_name", F.lit(rule.name))


def evaluate_rules(metrics: DataFrame, rules: list[AlarmRule], ts: str = "ts", value: str = "value",
                   metric_col: str = "metric_name") -> DataFrame:
    """(alarm_name, slot, n, value, state) of many rules in one scan of the points: every slot in which a rule has a
    datapoint. Slots without one are INSUFFICIENT and left out (``state_counts`` counts them). Points
    meet their rules by a broadcast join (a row per rule), are added up per rule and period, and each period is
    copied to the windows it belongs to.
    """
    spark = metrics.sparkSession
    known = spark.createDataFrame([(r.name, r.metric, r.statistic, r.period_s, float(r.threshold), r.comparison, r.evaluation_periods)
                                   for r in rules], "alarm_name string, _metric string, _stat string, _period long, _limit double, "
                                  "_cmp string, _n int")
    micros = epoch_micros(F.col(ts), _is_ntz(metrics, ts))
    points = (metrics.select(F.col(metric_col).alias("_metric"), micros.alias("_us"), F.col(value).alias("_v"))
              .filter(F.col("_us").isNotNull()).join(F.broadcast(known), "_metric")
              .withColumn("slot", F.floor(F.col("_us") / (F.col("_period") * 1_000_000)).cast("long")))
    group = ["alarm_name", "_stat", "_limit", "_cmp", "_n", "slot"]
    stats = points.groupBy(*group).agg(*[agg("_v").alias(name) for name, agg in _STATS.items()])
    v = F.coalesce(*[F.when(F.col("_stat") == name, F.col(name).cast("double")) for name in _STATS])
    breach = F.coalesce(*[F.when(F.col("_cmp") == name, cmp(F.col("value"), F.col("_limit"))) for name, cmp in _COMPARE.items()])
    periods = stats.withColumn("value", v).withColumn("_breach", F.coalesce(breach, F.lit(False)))
    windows = periods.select("alarm_name", "_n", "_breach", "value", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct((F.col("slot") + k).alias("slot"), (k == 0).alias("own")))).alias("w"))
    seen = (windows.groupBy("alarm_name", "_n", F.col("w.slot").alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_breach").cast("int")).alias("_hit"), F.max("w.own").alias("_own"),
                 F.max(F.when(F.col("w.own"), F.col("value"))).alias("value")).filter("_own"))
    state = F.when(F.col("n") < F.col("_n"), INSUFFICIENT).when(F.col("_hit") == F.col("_n"), ALARM).otherwise(OK)
    return seen.select("alarm_name", "slot", "n", "value", state.alias("state"))


def state_counts(states: DataFrame) -> DataFrame:
    """(alarm_name, state, periods) over each rule's first to last slot; slots that ``evaluate_rules`` left out are INSUFFICIENT."""
    by_state = states.groupBy("alarm_name", "state").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    per_rule = by_state.groupBy("alarm_name").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("counts"), (F.max("hi") - F.min("lo") + 1).alias("slots"),
        F.sum("n").alias("seen"))  # at most three states a rule
    every = per_rule.select("alarm_name", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), (
        F.coalesce(F.element_at("counts", F.lit(s)), F.lit(0)) + (F.col("slots") - F.col("seen") if s == INSUFFICIENT else F.lit(0))
    ).alias("periods")) for s in (OK, ALARM, INSUFFICIENT)])).alias("x"))
    return every.select("alarm_name", "x.state", "x.periods").filter("periods > 0")


def latency_points(latencies: DataFrame, captured: str = "captured_at", applied: str = "applied_at") -> DataFrame:
    """The latencies of changes (``cdc_latency``) as points of the two replication metrics: the source's when a change was
    captured, the target's when it was committed. A change that is not applied yet has no point of the second."""
    source = latencies.select(F.lit("CDCLatencySource").alias("metric_name"), F.col(captured).alias("ts"),
                              F.col("source_latency_s").cast("double").alias("value"))
    target = latencies.filter(F.col(applied).isNotNull()).select(
        F.lit("CDCLatencyTarget").alias("metric_name"), F.col(applied).alias("ts"), F.col("target_latency_s").cast("double").alias("value"))
    return source.unionByName(target)


def latency_alarms(points: DataFrame) -> DataFrame:
    """(alarm_name, period_start, previous_state, state): what the declared rules on replication latency notify."""
    out = None
    for rule in ALARM_RULES:
        if rule.metric in ("CDCLatencySource", "CDCLatencyTarget"):
            states = evaluate_rule(points, rule)
            told = alarm_transitions(states, ["alarm_name"], rule.period_s)
            out = told if out is None else out.unionByName(told)
    return out
