"""Phrase collocations per language, by the external streaming layout of n-gram estimation.

Counting runs level by level over the whole corpus. A phrase that occurs ``least`` times consists of parts that do, so
a level counts only what may be frequent: a filter of fixed size (one bit per CRC of language and phrase) that lets
every frequent part of the level below through. It drops nothing that could be frequent, at any size; where it fills up
it only lets more through. Each task counts its block by sorting exact local numbers, and Spark adds the blocks up.

The frequent phrases are then kept as two count streams: sorted by their words (prefix order) and by their words read
backwards (suffix order). In prefix order a phrase stands behind its first parts and before all its extensions to the
right; one walk with a stack of the phrases that enclose the current one yields every left count and the greatest right
extension. The walk over the suffix order yields right counts and left extensions, and both streams are merge-joined. The
streams are cut into ranges anywhere, also inside one first word: a range starts with the parts of its first
phrase (three at most, and the total), whose counts are looked up beforehand. No hash table is kept of phrases.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

from .common import read, shared_table

LEAST, LONGEST, TOP = 30, 4, 2000
SCORE, ABSORBED = 2_000_000, (100, 80)  # a phrase goes if 100 * f(longer) >= 80 * a
FILTER_BITS = 28                        # 32 MB, at every corpus size
BLOCK_WORDS = 2_500_000                 # words counted together in a task
ENTRIES = 600_000                       # distinct words held at once
SALT = 64                               # parts of a language that are ranked by themselves first

BREAK = b"."   # stands between pieces; no word has it
# A-Z lower-cased, and every end of a piece as BREAK
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz.........")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, with BREAK between its pieces."""
    return (text or "").encode().translate(_PLAIN).replace(b".", b" . ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str | None]]:
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1)
        for i, lang in enumerate(langs):
            yield (b"und" if lang is None else lang.encode()), texts[i].as_py()


def _batch(lang: bytes, phrases: list[bytes], counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang.decode()] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
         pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and under the empty phrase the number of all words, per language."""
    held: dict[bytes, Counter] = {}
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            c.pop(BREAK, 0)
            c[b""] = sum(c.values())
            yield _batch(lang, list(c), list(c.values()))
        held.clear()

    for lang, text in _texts(batches):
        c = held.setdefault(lang, Counter())
        entries -= len(c)
        c.update(words_of(text))
        entries += len(c)
        if entries > ENTRIES:
            yield from flush()
            entries = 0
    yield from flush()


class _Local(dict):
    """Local numbers from 1 of the words of a language that the filter lets through; 0 for the others."""

    def __init__(self, lang: bytes, bits: np.ndarray):
        self.lang, self.bits, self.words = lang, bits, [BREAK]
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        n = 0
        if _passes(self.bits, self.lang, word):
            n = len(self.words)
            self.words.append(word)
        self[word] = n
        return n


def _passes(bits: np.ndarray, lang: bytes, phrase: bytes) -> bool:
    at = zlib.crc32(lang + b"\0" + phrase) & (8 * len(bits) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True, return_counts=True)


def _pairs(ids: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Pairs of neighbours that are both numbered: positions, number of each, distinct pairs' counts, phrases and words."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    keys, number, count = _distinct(ids[at] * len(words) + ids[at + 1])
    first, second = np.divmod(keys, len(words))
    phrases = [words[a] + b" " + words[b] for a, b in zip(first.tolist(), second.tolist())]
    return at, number, count, phrases, second


def _longer(lang: bytes, ids: np.ndarray, words: list[bytes], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of 3 and 4 words all of whose pairs of neighbours the filter lets through."""
    at, number, _, phrases, second = _pairs(ids, words)
    allowed = np.fromiter((_passes(bits, lang, p) for p in phrases), bool, len(phrases))
    pair = np.full(len(ids), -1, np.int64)
    good = allowed[number]
    pair[at[good]] = number[good]
    three = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    keys, _, count = _distinct(pair[three] * len(phrases) + pair[three + 1])
    yield _batch(lang, [phrases[a] + b" " + words[second[b]] for a, b in zip(*(x.tolist() for x in np.divmod(keys, len(phrases) or 1)))],
                 count)
    four = three[np.isin(three + 1, three, assume_unique=True)]
    keys, _, count = _distinct(pair[four] * len(phrases) + pair[four + 2])
    yield _batch(lang, [phrases[a] + b" " + phrases[b] for a, b in zip(*(x.tolist() for x in np.divmod(keys, len(phrases) or 1)))],
                 count)


def _blocks(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
    """Texts of one language together: their words as local numbers, 0 between pieces, and the numbered words."""
    held: dict[bytes, tuple[_Local, list[np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
        for lang, (local, parts) in held.items():
            yield lang, np.concatenate(parts), local.words
        held.clear()

    for lang, text in _texts(batches):
        words = words_of(text)
        local, parts = held.setdefault(lang, (_Local(lang, bits), []))
        parts += [np.fromiter(map(local.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        size += len(words)
        if size > BLOCK_WORDS:
            yield from flush()
            size = 0
    yield from flush()


def _added_up(parts: DataFrame, least: int) -> DataFrame:
    """Phrases of at least ``least`` occurrences, and the totals."""
    return (parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            .filter((F.col("f") >= least) | (F.col("phrase") == "")))


def filter_of(counts: DataFrame) -> bytes:
    """A bit for the CRC of each counted phrase, as compressed bytes; its size does not depend on the corpus."""
    at = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.encode("phrase", "UTF-8"))) % (1 << FILTER_BITS)
    words = (counts.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return zlib.compress(out.tobytes(), 1)


def count_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, f): all phrases of 1 to LONGEST words that occur at least ``least`` times, and per language the
    number of its words under the empty phrase; written to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = "lang string, phrase string, f long"
    ones = shared_table(_added_up(texts.mapInArrow(_count_words, kind), least), "words")
    words_bits = spark.sparkContext.broadcast(filter_of(ones.filter(F.col("phrase") != "")))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _blocks(batches, _bits(words_bits.value)):
            _, _, count, phrases, _ = _pairs(ids, words)
            yield _batch(lang, phrases, count)

    twos = shared_table(_added_up(texts.mapInArrow(count_pairs, kind), least), "pairs")
    pairs_bits = spark.sparkContext.broadcast(filter_of(twos))

    def count_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(pairs_bits.value)
        for lang, ids, words in _blocks(batches, _bits(words_bits.value)):
            yield from _longer(lang, ids, words, bits)

    longer = _added_up(texts.mapInArrow(count_longer, kind), least)
    every = ones.unionByName(twos).unionByName(longer)
    split = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return shared_table(every.select("lang", split.alias("words"), "f"), "phrases")


def walk(rows: Iterator[tuple[str, tuple[str, ...], int]], start: list[tuple[str, tuple[str, ...], int]]
         ) -> Iterator[tuple[str, tuple[str, ...], int | None, list[int], int]]:
    """A count stream in order: (lang, words, f, counts of its first parts from the empty one on, greatest count of
    an extension by one word). ``start``: the parts of the first phrase; they come out with f None, for their
    extensions in this range."""
    stack: list[list] = [[lang, words, f, None, 0] for lang, words, f in start]

    def done(e: list) -> tuple:
        return (e[0], e[1], None if e[3] is None else e[2], e[3] or [], e[4])

    for lang, words, f in rows:
        while stack and (stack[-1][0] != lang or stack[-1][1] != words[:len(stack[-1][1])]):
            yield done(stack.pop())
        if stack:
            stack[-1][4] = max(stack[-1][4], f)
        stack.append([lang, words, f, [e[2] for e in stack], 0])
    while stack:
        yield done(stack.pop())


def _stream(counts: DataFrame, partitions: int) -> DataFrame:
    """(lang, words, f, parts, longer) of the phrases in ``counts``, by one walk over each range of their order."""
    checkpoint_dir(counts.sparkSession)
    ranged = (counts.repartitionByRange(partitions, "lang", "words").sortWithinPartitions("lang", "words")
              .withColumn("at", F.spark_partition_id()).checkpoint(eager=True))
    # the first parts of each range's first phrase: at most LONGEST rows per range
    firsts = ranged.groupBy("at").agg(F.min(F.struct("lang", "words")).alias("x")).select("at", "x.*").filter(F.size("words") > 0)
    parts = firsts.select("at", "lang", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.slice("words", F.lit(1), k))).alias("words"))
    edges: dict[int, list] = {}
    known = ranged.select("lang", "words", "f").join(F.broadcast(parts), ["lang", "words"])
    for r in known.collect():
        edges.setdefault(r["at"], []).append((r.lang, tuple(r.words), r.f))
    for own in edges.values():
        own.sort(key=lambda e: len(e[1]))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, tuple[str, ...], int]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), map(tuple, b.column(1).to_pylist()), b.column(2).to_pylist())

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        held, batches = [], _with(first, batches)
        for x in walk(rows(), edges.get(first.column(3)[0].as_py(), [])):
            held.append(x)
            if len(held) >= 5000:
                yield _walked(held)
                held = []
        yield _walked(held)

    out = ranged.mapInArrow(walked, "lang string, words array<string>, f long, parts array<long>, longer long")
    # a phrase at the end of one range may have extensions in the next ones
    return out.groupBy("lang", "words").agg(F.max("f").alias("f"), F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _walked(rows: list[tuple]) -> pa.RecordBatch:
    lang, words, f, parts, longer = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array(f, pa.int64()),
         pa.array(parts, pa.list_(pa.int64())), pa.array(longer, pa.int64())], names=["lang", "words", "f", "parts", "longer"])


def collocations(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, a, n, l, r, score) of every phrase of 2 to LONGEST words with a >= ``least`` occurrences that no
    longer one absorbs, with the cut of the least score (then of the shortest first part).

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at spaces and
    tabs. A null or empty text has no words; a null lang counts as ``und``; repeated rows count as often as they
    occur; an empty table gives no rows; other columns are not read. Counts are exact.
    """
    counts = count_phrases(docs, least)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _stream(counts, partitions)
    right = _stream(counts.withColumn("words", F.reverse("words")), partitions).select(
        "lang", F.reverse("words").alias("words"), F.col("parts").alias("ends"), F.col("longer").alias("before"))
    both = left.join(right.hint("merge"), ["lang", "words"])
    size = F.size("words")
    big = "CAST({} AS DECIMAL(20,0))"
    longer = F.greatest("longer", "before").cast("decimal(20,0)")
    kept = both.filter(size.between(2, LONGEST) & (longer * ABSORBED[0] < F.col("f").cast("decimal(20,0)") * ABSORBED[1]))
    # parts[k]: the first k words; ends[k]: the last k words; both start with the total
    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.get("parts", F.lit(0)).alias("n"), F.expr(
        f"transform(sequence(1, size(words) - 1), k -> struct({big.format('f')} * {SCORE} div "
        f"({big.format('parts[k]')} + {big.format('ends[size(words) - k]')}) AS score, k, "
        "parts[k] AS l, ends[size(words) - k] AS r))").alias("cuts"))
    cut = F.array_min("cuts")
    return cuts.select("lang", "words", "a", "n", cut["l"].alias("l"), cut["r"].alias("r"), cut["score"].alias("score"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` by score and occurrences (falling) and phrase (in UTF-8 byte order), with rank and phrase."""
    out = found.withColumn("phrase", F.array_join("words", " ")).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    # first within parts of a language, so that no task sees more of a large one than ``top`` rows a part
    for part in (["lang", "_part"], ["lang"]):
        order = Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return out.drop("_part")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    out = top_phrases(collocations(read(spark, sf_dir, "documents").select("lang", "text")))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
x AS (SELECT lang, unnest([ws[i:i], ws[i:i+1], ws[i:i+2], ws[i:i+3]]) AS phrase,
             unnest([i, i + 1, i + 2, i + 3]) AS last, len(ws) AS size FROM g),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM x WHERE last <= size GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(phrase) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a FROM f WHERE len(phrase) > 1 AND f >= {LEAST}),
inner_parts AS (SELECT lang, a, unnest([phrase[1:2], phrase[2:3], phrase[3:4], phrase[1:3], phrase[2:4]]) AS phrase, len(phrase) AS size
      FROM c WHERE len(phrase) > 2),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts WHERE len(phrase) BETWEEN 2 AND size - 1 GROUP BY lang, phrase),
kept AS (SELECT c.* FROM c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase
      WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * c.a),
cut AS (SELECT lang, phrase, a, unnest(generate_series(1, len(phrase) - 1)) AS k FROM kept),
s AS (SELECT cut.*, x.f AS l, y.f AS r, ({SCORE}::HUGEINT * cut.a // (x.f + y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.phrase[1:cut.k]
               JOIN f y ON y.lang = cut.lang AND y.phrase = cut.phrase[cut.k + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
r AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM b)
SELECT * FROM (SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY r.score DESC, r.a DESC, r.phrase) AS rank,
       r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang) WHERE rank <= {TOP}
"""
