"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

All shingles are hashed once; the top bits of a hash name its bin, the least hash of each bin is
kept. Bins left empty are filled by optimal densification: each bin has its own fixed pseudo-random
order of all bins and copies the first of them that is filled. Of each bin the low BITS bits are
stored; the likeness of two fingerprints is their share of equal bins, corrected for the 2**-BITS
of bins that agree by chance.

Sorting the hashes together with one closing value per bin brings each bin's least value to a
known place, so that no map or grouping is needed: a text's fingerprint is made within its row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8                     # stored per bin
BUCKET_ROWS = 1000           # documents of a range of ids, about
MAX_BUCKETS = 1 << 16
WHITE = r"[\x20\x09-\x0D]+"
LOW = 64 - BIN_BITS


def _closers() -> list[int]:
    """The greatest hash of each bin, in signed order of the bins."""
    return [((b + 1) << LOW) - 1 for b in range(-(BINS // 2), BINS // 2)]


def _probes(seed: int = 11) -> list[list[int]]:
    """For each bin the order in which it tries the others."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(BINS).tolist() for _ in range(BINS)]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that later expressions read instead of computing them again.

    Lambdas read their outer columns once per element, so what they read must be a finished column.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))))


def with_bins(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``into``: the BINS stored values (0 to 2**BITS - 1) of the text's shingles.

    Shingles are SHINGLE consecutive words; a text of fewer words is one shingle, and a text
    without words, or null, has an empty array.
    """
    words, hashes, least = "_words", "_hashes", "_least"
    df = settled(df, **{words: F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), "")})
    shingles = F.expr(f"""
        CASE WHEN size({words}) = 0 THEN array()
             WHEN size({words}) < {SHINGLE} THEN array(xxhash64({words}))
             ELSE transform(sequence(0, size({words}) - {SHINGLE}),
                            i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(SHINGLE))})) END""")
    closers = F.array(*[F.lit(c).cast("long") for c in _closers()])
    df = settled(df.withColumn(words, shingles), **{hashes: F.sort_array(F.concat(F.col(words), closers))}).drop(words)
    df = settled(df, **{least: F.expr(
        f"filter({hashes}, (x, i) -> i = 0 OR shiftright(x, {LOW}) != shiftright({hashes}[i - 1], {LOW}))")}).drop(hashes)
    closed = (1 << LOW) - 1
    probes = F.array(*[F.array(*map(F.lit, p)) for p in _probes()])
    df = df.withColumn("_probes", probes)
    filled = f"x & {closed}L != {closed}L"
    values = F.expr(f"""
        CASE WHEN NOT exists({least}, x -> {filled}) THEN array()
             ELSE transform({least}, (x, i) -> CAST((CASE WHEN {filled} THEN x ELSE
                  {least}[filter(_probes[i], j -> {least}[j] & {closed}L != {closed}L)[0]] END)
                  & {(1 << BITS) - 1} AS SMALLINT)) END""")
    return settled(df, **{into: values}).drop(least, "_probes")


def packed(bins: str) -> Column:
    """The stored bits as a hexadecimal string, bin by bin (empty for a text without words)."""
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(1 << BITS)])
    return F.array_join(F.transform(F.col(bins), lambda x: F.element_at(digits, x.cast("int") + 1)), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity from two bin columns: 1 for two empty ones, 0 for one."""
    chance = 2.0 ** -BITS
    equal = F.size(F.filter(F.zip_with(F.col(a), F.col(b), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1.0 - chance))))


def _bucket(bounds: list[int]) -> Column:
    """The number of ``bounds`` (ascending) up to doc_id, looked up in two steps; -1 for a null id."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    at = upto(tops)
    return (F.when(F.col("doc_id").isNull(), -1).when(at == 0, 0)
            .otherwise((at - 1) * step + upto(F.element_at(inner, F.greatest(at, F.lit(1))))))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bins, next_text, next_bins): each document with the next one by descending id.

    Ids are cut into ranges of about equal rows; within a range the next row follows by a window,
    and a range's last row takes the first of the next lower range (after the last range: the first).
    Null ids come last; rows of one id follow by the hash of their text. The texts move once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id").count()
    n = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    keyed = docs.withColumns({"_hash": F.xxhash64("text"), "_bucket": _bucket(sorted(set(bounds or [])))})
    firsts = sorted(keyed.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_hash")).alias("k")).collect(), reverse=True)
    edges = spark.createDataFrame(
        [(b, *firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)],
        "_edge int, _id long, _th long")
    edge = (with_bins(keyed.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
                      .select("_edge", "text").groupBy("_edge").agg(F.first("text").alias("edge_text")),
                      "edge_text", "edge_bins"))
    order = Window.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_hash").desc())
    chained = (with_bins(keyed, "text", "bins")
               .withColumn("_next", F.lead(F.struct("text", "bins")).over(order))
               .join(edge, F.col("_bucket") == F.col("_edge"), "left"))
    return chained.select("doc_id", "text", "bins",
                          F.coalesce("_next.text", "edge_text").alias("next_text"),
                          F.coalesce("_next.bins", "edge_bins").alias("next_bins"))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    chained = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("CAST(n_chars DIV 2 AS INT)")
    edited = settled(chained, edited=F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left("next_text", cut)))
    out = with_bins(edited.drop("text", "next_text"), "edited", "edited_bins")
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
                      likeness("bins", "edited_bins").alias("near_edited"),
                      likeness("bins", "next_bins").alias("near_next"))
