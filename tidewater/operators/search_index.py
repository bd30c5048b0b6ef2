"""Ranked text search over an inverted index (Q14).

The index is a pair of tables, both in hash buckets with committed versions (``sinks.target``): postings (id, place, entries)
by place, a hash of the term, and documents (id, terms) by id. ``entries`` has a line "term tf" for each term
that a document has in a place: the postings travel and are rewritten in that form, a few bytes each, and a document's terms
are counted where it is read. A search reads the places of its terms alone; an update reads the old terms of the changed
documents and rewrites only the places of terms that they had or have.

Score of a document: the sum over the query's terms of tf * idf * idf, idf = log10(documents / documents with the term),
rounded to 6 places; ties by id.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import unaccented
from ..sinks.target import merge_into_buckets, read_bucketed, write_bucketed
from .joins import BROADCAST_BYTES

LEAST_LETTERS, BUCKETS, SPREAD = 3, 64, 32   # a place with many postings is written by up to SPREAD tasks
PLACE = "place"
SENT_ROWS = 1 << 16   # rows per batch that a task hands on


def tokens(text: Column, least: int = LEAST_LETTERS) -> Column:
    """The words of a text: lower-cased, without accents, of letters and digits of any script, ``least`` of them or more."""
    return F.filter(F.split(F.lower(unaccented(text)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def place_of(term: Column, buckets: int) -> Column:
    """Where a term's postings are; ``_postings`` computes the same."""
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def _postings(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(key, place, entries), a row per document and place. A text without words has no rows."""
    words = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    schema = T.StructType([words.schema[key], T.StructField(PLACE, T.IntegerType()), T.StructField("entries", T.StringType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, places, entries = [], [], []

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(places, pa.int32()),
                                                   pa.array(entries, pa.string())], names=schema.names)

            for i, own in enumerate(b.column(1)):
                lines: dict[int, list[str]] = {}
                for term, tf in Counter(own.as_py()).items():
                    lines.setdefault(zlib.crc32(term.encode()) % buckets, []).append(f"{term} {tf}")
                of += [i] * len(lines)
                places += lines
                entries += map("\n".join, lines.values())
                if len(of) >= SENT_ROWS:
                    yield rows()
                    of, places, entries = [], [], []
            yield rows()

    return words.mapInArrow(count, schema)


def _forward(docs: DataFrame, key: str, text: str) -> DataFrame:
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, F.concat_ws(" ", F.array_distinct(words)).alias("terms"))


def _hinted(keys: DataFrame, key: str) -> DataFrame:
    """Checkpointed keys, marked for broadcast if they are few."""
    size = keys.agg(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 32)).first()[0]
    return F.broadcast(keys) if (size or 0) <= BROADCAST_BYTES else keys


def build_index(docs: DataFrame, key: str, text: str, root: str, buckets: int = BUCKETS) -> None:
    """Index ``docs`` (one row per ``key``) under ``root``."""
    write_bucketed(_postings(docs, key, text, buckets), f"{root}/postings", F.col(PLACE), buckets, spread=SPREAD)
    write_bucketed(_forward(docs, key, text), f"{root}/documents", key, buckets)


def update_index(spark: SparkSession, root: str, docs: DataFrame, key: str, text: str, deleted: DataFrame | None = None,
                 buckets: int = BUCKETS) -> None:
    """Put ``docs`` (new or changed, one row per ``key``) into the index and take the keys of ``deleted`` out.

    The postings go first, then the documents; an update that dies between them is repeated as it was.
    """
    gone = docs.select(key) if deleted is None else docs.select(key).unionByName(deleted.select(key)).distinct()
    gone = _hinted(gone.checkpoint(eager=True), key)
    old = read_bucketed(spark, f"{root}/documents").filter(F.col(key).isNotNull()).join(gone, key, "left_semi")
    fresh = _postings(docs, key, text, buckets).checkpoint(eager=True)
    had = old.select(F.explode(F.split("terms", " ")).alias("term")).filter("term <> ''").select(place_of(F.col("term"), buckets).alias(PLACE))
    touched = had.unionByName(fresh.select(PLACE)).distinct().checkpoint(eager=True)

    def postings(current: DataFrame, _: DataFrame) -> DataFrame:
        return current.join(gone, key, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))

    merge_into_buckets(spark, f"{root}/postings", touched, F.col(PLACE), buckets, postings, spread=SPREAD)
    merge_into_buckets(spark, f"{root}/documents", gone, key, buckets, lambda current, _: current.join(
        gone, key, "left_anti").select(*current.columns).unionByName(_forward(docs, key, text)))


def search_index(spark: SparkSession, root: str, queries: list[str], key: str, k: int | None = 10, buckets: int = BUCKETS) -> DataFrame:
    """(query, key, score, matched_terms, place): the best ``k`` documents (all if None) of each query.

    Repeated queries count once; a query without words finds nothing.
    """
    asked = spark.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
    wanted = asked.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    places = [r[0] for r in wanted.select(place_of(F.col("term"), buckets)).distinct().collect()]  # at most ``buckets``
    lines = read_bucketed(spark, f"{root}/postings", places).select(key, F.explode(F.split("entries", "\n")).alias("line"))
    # a key that had several rows has its counts added up
    found = (lines.select(key, F.substring_index("line", " ", 1).alias("term"), F.substring_index("line", " ", -1).cast("long").alias("tf"))
             .join(F.broadcast(wanted.select("term").distinct()), "term").groupBy(key, "term").agg(F.sum("tf").alias("tf")))
    n = read_bucketed(spark, f"{root}/documents").count()
    idf = F.log10(F.lit(float(n)) / F.col("df"))
    weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (idf * idf).alias("weight"))
    scored = (found.join(F.broadcast(weights), "term").join(F.broadcast(wanted), "term")
              .groupBy("query", key).agg(F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"),
                                         F.count(F.lit(1)).alias("matched_terms")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    ranked = scored.withColumn("place", F.row_number().over(order).cast("long"))
    return ranked if k is None else ranked.filter(F.col("place") <= k)
