"""Line dedup by levelled sorted runs of line hashes.

The corpus arrives in batches of ascending ids. The store keeps runs: sorted tables of
(128-bit line hash, first document). A batch reduces its lines to one row per hash, anti-joins
all runs, adds its new hashes as a run of level 0, and FANOUT runs of a level are merged into one
of the next, so that a hash is rewritten once per level only. A line goes if its hash is in the
runs, or was first seen in an earlier document of its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, raw_texts, read, sheltered, shared_table

MIN_CHARS = 10    # code points of a key, at least
BATCHES = 6
FANOUT = 3        # runs of a level before they are merged


def _keys(text: bytes) -> list[bytes]:
    return [line.strip().lower() for line in text.split(b"\n")]


def _hash(key: bytes) -> bytes | None:
    """128-bit hash of a key of MIN_CHARS code points; shorter ones have none."""
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2): the distinct line hashes of each document."""
    for b in batches:
        ids, digests = [], []
        for doc_id, text in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
            own = {h for k in set(_keys(text)) if (h := _hash(k))}
            ids += [doc_id] * len(own)
            digests += own
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])),
             pa.array(np.ascontiguousarray(h[:, 1]))], names=["doc_id", "h1", "h2"])


class LineRuns:
    """The runs, by level. ``add`` takes a batch's (doc_id, h1, h2) rows whose ids are above all earlier ones."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        for run in self.runs():
            fresh = fresh.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(0, shared_table(fresh.sortWithinPartitions("h1", "h2"), "line-run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merged = self.levels[level][0]
            for more in self.levels[level][1:]:
                merged = merged.unionByName(more)
            self.levels[level] = []
            self._push(level + 1, shared_table(
                merged.repartition("h1").sortWithinPartitions("h1", "h2"), "line-run"))

    def table(self) -> DataFrame | None:
        """All runs: each hash once, with the first document that holds it."""
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids at which the batches after the first begin (about equal rows; few numbers)."""
    marks = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(marks or []))


@sheltered("_late", "_id")
def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with every line dropped whose key an earlier document (smaller doc_id) holds.

    Keys: the line stripped of ASCII white space, A-Z lower-cased; those under MIN_CHARS code
    points are never dropped, and a document keeps all its own repeats. Adds n_lines,
    n_dropped (columns of these names are replaced). A null or empty text is one empty line and
    stays as it is; a row without doc_id is kept whole and drops nothing; rows of one doc_id are
    one document.
    """
    lines = shared_table(
        docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long"), "text").mapInArrow(_lines, "doc_id long, h1 long, h2 long"),
        "lines")
    bounds = batch_bounds(docs, batches)
    store = LineRuns()
    for i in range(len(bounds) + 1):
        part = lines
        if i:
            part = part.filter(F.col("doc_id") >= bounds[i - 1])
        if i < len(bounds):
            part = part.filter(F.col("doc_id") < bounds[i])
        store.add(part)
    # hashes that a later document than their first one holds, gathered by document (a document's own lines)
    late = (lines.join(store.table(), ["h1", "h2"]).filter(F.col("doc_id") > F.col("first"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_late")))
    docs = clear_of(docs, "n_lines", "n_dropped")
    joined = docs.join(late.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lates = raw_texts(b.column(at)), b.column(len(names))
            starts = lates.offsets.to_numpy()
            pairs = lates.values  # fields h1, h2 of all rows in order
            flat = np.stack([pairs.field(i).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1)], 1
                            ) if len(pairs) else np.zeros((0, 2), "<i8")
            kept, n_lines, n_dropped = [], [], []
            for i, text in enumerate(texts):
                rows = text.split(b"\n")
                gone = {flat[j].tobytes() for j in range(starts[i], starts[i + 1])} if lates[i].is_valid else set()
                stay = [r for r in rows if _hash(r.strip().lower()) not in gone] if gone else rows
                kept.append(b"\n".join(stay))
                n_lines.append(len(rows))
                n_dropped.append(len(rows) - len(stay))
            text = pa.array(kept, pa.binary()).cast(b.column(at).type)
            if b.column(at).null_count:
                import pyarrow.compute as pc
                text = pc.if_else(pc.is_valid(b.column(at)), text, pa.nulls(len(text), text.type))
            cols = [text if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*names, "n_lines", "n_dropped"])

    from pyspark.sql.types import LongType, StructType
    schema = StructType([*docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    return joined.select(*names, "_late").mapInArrow(cut, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
m AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT l.*, (m.first IS NOT NULL AND m.first < l.doc_id) AS gone FROM l LEFT JOIN m ON l.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
