"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of an item. A document can hold a window only if it holds
all its shingles, so it is enough to look for one of them: shingles are ordered by how often
the whole corpus has them, and each window is looked up by its rarest (containment of all a
window's shingles needs a prefix of one). A window with a shingle that the corpus lacks is dropped. A
match fixes how item and document lie against each other; length and position bounds drop
windows that would stick out, and the words of each window left are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, sheltered, shared_table

WINDOW = 13
SHINGLE = 3
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"       # of lower-cased text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = 256                    # windows that one piece of an item holds, at most
SHARE = 20                     # contaminated: 1 / SHARE of the words are hit, at least
BROADCAST_BYTES = 4 << 20      # of benchmark text whose shingles are broadcast; beyond it, shuffled joins


def _words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))  # pure ASCII has the faster way
    return F.array_remove(F.split(lowered, DELIMITERS), "")


def _shingle(q: int, words: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(q), *[F.get(words, at + i) for i in range(q)])


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, start, len, q): each item's windows; q words make its shingles.

    A long item is cut into pieces that overlap by all but one word of a window, so that every window lies in
    one piece, and a row holds a piece's words, not the item's; ``start`` counts from the piece's head.
    """
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                              _words(F.col("text")).alias("words"))
             .filter(F.size("words") > 0)
             .withColumn("len", F.least(F.lit(WINDOW), F.size("words")))
             .withColumn("q", F.least(F.lit(SHINGLE), F.col("len")))
             .withColumn("_head", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"), F.lit(PIECE))))
             .withColumn("words", F.slice("words", F.col("_head") + 1, F.lit(PIECE - 1) + F.col("len"))).drop("_head"))
    return items.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))))


def _positions(docs: DataFrame, q: int) -> DataFrame:
    """(doc_id, _text_hash, words, pos, key): every shingle of q words of every document."""
    spread = docs.select("doc_id", "_text_hash", "words", F.posexplode("words").alias("pos", "_word"))
    return (spread.filter(F.col("pos") <= F.size("words") - q)
            .withColumn("key", _shingle(q, F.col("words"), F.col("pos"))).drop("_word"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def window_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Occurrences of item windows: (doc_id, _text_hash, item_id, starts, len), starts by word from 0.

    Documents are told apart by id and text; rows equal in both stand for each other.
    """
    windows = shared_table(_item_windows(benchmark), "item-windows")
    lengths = [r[0] for r in windows.select("q").distinct().collect()]  # of at most SHINGLE values
    small = (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    tokenised = _keyed(docs.select("doc_id", "text")).select(
        "doc_id", "_text_hash", _words(F.col("text")).alias("words"))
    found = None
    for q in sorted(lengths):
        shingles = (windows.filter(F.col("q") == q)
                    .withColumn("p", F.explode(F.expr("sequence(start, start + len - q)")))
                    .withColumn("key", _shingle(q, F.col("words"), F.col("p"))))
        positions = _positions(tokenised, q)
        # rarity: how often the corpus has each shingle of the benchmark
        counts = shared_table(
            positions.select("key").join(hint(shingles.select("key").distinct()), "key", "left_semi")
            .groupBy("key").count(), "shingle-counts")
        prefix = (shingles.join(hint(counts), "key", "left")
                  .withColumn("count", F.coalesce("count", F.lit(0)))
                  .groupBy("item_id", "words", "start", "len")
                  .agg(F.min(F.struct("count", "key", "p")).alias("rarest"))
                  .filter("rarest.count > 0")
                  .groupBy("item_id", "words", "len", F.col("rarest.key").alias("key"), F.col("rarest.p").alias("p"))
                  .agg(F.sort_array(F.collect_set("start")).alias("starts")))
        # of the item only the words around the shingle travel along
        low = F.element_at("starts", 1)
        prefix = prefix.select("key", "item_id", "p", "len", "starts", low.alias("low"),
                               F.slice("words", low + 1, F.element_at("starts", -1) - low + F.col("len")).alias("near"))
        prefix = shared_table(prefix, "prefix")
        if small:
            met = positions.join(F.broadcast(prefix), "key")
        else:  # positions travel without words; each document's words come to its matches once
            known = tokenised.dropDuplicates(["doc_id", "_text_hash"]).withColumnsRenamed({"doc_id": "_id", "_text_hash": "_th"})
            met = (positions.select("doc_id", "_text_hash", "pos", "key").join(prefix, "key")
                   .join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th"))))
        # a segment of the document is kept; only segments, never whole word arrays, leave the join
        matched = (met.withColumn("from", F.expr("greatest(pos - p + low, 0)"))
                   .select(F.inline(F.array(F.struct(
                       "doc_id", "_text_hash", "item_id", "len", "starts", "low", "near", "from",
                       F.expr("pos - p").alias("shift"), F.size("words").alias("n_words"),
                       F.slice("words", F.col("from") + 1, F.size("near")).alias("segment"))))))
        hits = (matched.withColumn("starts", F.expr("""
                    transform(filter(starts, s -> shift + s >= 0 AND shift + s + len <= n_words
                        AND slice(segment, greatest(shift + s - from, 0) + 1, len) = slice(near, s - low + 1, len)),
                        s -> shift + s)"""))
                .filter(F.size("starts") > 0)
                .select("doc_id", "_text_hash", "item_id", "starts", "len"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:  # no item has words
        found = windows.sparkSession.createDataFrame(
            [], "doc_id long, _text_hash long, item_id string, starts array<int>, len int")
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, _text_hash, n_words, n_hit, items (sorted ids), contaminated.

    Null texts have no words; an item without words is in no document; repeated item ids count
    once; an empty benchmark or table gives no hits or no rows.
    """
    # places are a set: items that share a window add nothing, a document has at most WINDOW lengths at each word
    hits = (window_hits(docs, benchmark)
            .select("doc_id", "_text_hash", "item_id", "len", F.explode("starts").alias("start"))
            .groupBy("doc_id", "_text_hash")
            .agg(F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(
                x["start"], x["start"] + x["len"] - 1))))).cast("long").alias("n_hit"),
                 F.sort_array(F.collect_set("item_id")).alias("items"))
            .withColumnsRenamed({"doc_id": "_id", "_text_hash": "_th"}))
    rows = _keyed(docs.select("doc_id", "text")).select(
        "doc_id", "_text_hash", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th")), "left")
    return (out.drop("_id", "_th")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))))


@sheltered("_text_hash", "_id", "_th")
def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; columns and other rows are unchanged."""
    bad = (contamination(docs, benchmark).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_th")).distinct())
    keyed = _keyed(docs)
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th")),
                      "left_anti").select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s
        FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ls WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.s, dw.n, bw.id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(it.n_items, 0)::BIGINT AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
