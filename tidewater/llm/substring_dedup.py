"""Substring dedup by level-wise doubling.

A window of MIN_WORDS words that occurs twice has each of its shorter windows twice. So windows of
about half that length are counted first, and only what repeats there is looked at in windows of
twice the length. Of the half windows it is enough to count one per long window: the one with
the least hash in it, which is the same wherever the long window stands (about one word in ten).

Neighbouring long windows with the same half window form a run. A run whose whole stretch of words
repeats is settled at once; only runs whose stretch is unique, and one copy of each other stretch
around the same half window, are counted window by window. Levels above MIN_WORDS would only tell how
long the repeats are; ``spans`` gives that directly, as neighbouring repeated windows join.

All joins are by hash, with counts pre-aggregated; texts are held once per distinct text and move once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import _powers, clear_of, grouped, mix, raw_texts, read, sheltered, shared_table, window_hashes, word_hashes

MIN_WORDS = 35
U64 = np.uint64
_POSITION = 24          # bits of a position within a block of windows
_BLOCK = 1 << 22


def half(long: int) -> int:
    """Length of the level below: two such windows, one word shared at most, make a long one."""
    return (long + 1) // 2


class Runs:
    """The runs of several texts: word offsets, long windows by run, and the hashes of each run."""

    def __init__(self, texts: list[bytes], long: int) -> None:
        words, self.offsets = word_hashes(texts)
        short, n = half(long), len(words) - long + 1
        self.words, self.long = words, long
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.at, self.owner = empty, empty, empty, empty
        self.anchor, self.stretch = np.zeros(0, U64), np.zeros(0, U64)
        if n <= 0:
            return
        owner = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        valid = owner[:n] == owner[long - 1:]
        hashes = window_hashes(words, short)
        at = self._least(hashes, n, long - short + 1)
        index = np.flatnonzero(valid)
        if not len(index):
            return
        new = np.ones(len(index), bool)
        new[1:] = (np.diff(index) > 1) | (at[index[1:]] != at[index[:-1]])
        start = np.flatnonzero(new)
        self.first = index[start]
        self.last = index[np.append(start[1:], len(index)) - 1]
        self.at = at[self.first]
        self.owner = owner[self.first]
        self.anchor = hashes[self.at]
        up, down = _powers(len(words) + 1, 1)
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:len(words)], out=sums[1:])
        length = (self.last - self.first).astype(U64)
        self.stretch = mix((sums[self.last + long] - sums[self.first]) * down[self.first]
                           + length + self.anchor * U64(3))

    @staticmethod
    def _least(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
        """For each of n windows, where the least of its ``width`` hashes stands (leftmost of equals)."""
        out = np.empty(n, np.int64)
        low = U64((1 << _POSITION) - 1)
        for s in range(0, n, _BLOCK):
            m = min(_BLOCK, n - s)
            x = hashes[s:s + m + width - 1] & ~low
            x |= np.arange(len(x), dtype=U64)
            span = 1
            while span < width:  # least of the next ``span`` entries, span doubling
                step = min(span, width - span)
                x = np.minimum(x[:len(x) - step], x[step:])
                span += step
            out[s:s + m] = s + (x[:m] & low).astype(np.int64)
        return out

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, start) of every long window of the chosen runs."""
        sizes = (self.last - self.first + 1)[chosen]
        run = np.repeat(chosen, sizes)
        skip = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return run, self.first[run] + skip

    def window_hash(self, starts: np.ndarray) -> np.ndarray:
        up, down = _powers(len(self.words) + 1, 0)
        sums = np.zeros(len(self.words) + 1, U64)
        np.cumsum(self.words * up[:len(self.words)], out=sums[1:])
        return mix((sums[starts + self.long] - sums[starts]) * down[starts] + U64(self.long))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Each row's list of longs as unsigned hashes (null: none)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    offsets, good = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[i]:offsets[i + 1]] if good[i] else values[:0] for i in range(len(column))]


def text_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})


def _all_runs(keyed: DataFrame, long: int) -> DataFrame:
    """(anchor, stretch, _t1, n): each text's distinct runs and how often it has them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, texts = b.column(0).to_numpy(), raw_texts(b.column(1))
            for lo, hi in grouped(texts):
                r = Runs(texts[lo:hi], long)
                if len(r.first):
                    order = np.lexsort((r.stretch, r.owner))
                    s, o = r.stretch[order], r.owner[order]
                    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1]))))
                    n = np.diff(np.append(new, len(s)))
                    yield pa.RecordBatch.from_arrays(
                        [_signed(r.anchor[order][new]), _signed(s[new]), pa.array(key[lo + o[new]]),
                         pa.array(n.astype(np.int64))], names=["anchor", "stretch", "_t1", "n"])

    return keyed.select("_t1", "text").mapInArrow(emit, "anchor long, stretch long, _t1 long, n long")


def repeated(docs: DataFrame, long: int = MIN_WORDS, keep_text: bool = True) -> DataFrame:
    """Per distinct text: _t1, _t2, n_words, n_removed, spans, kept (the text, or its sha256 alone).

    spans: the covered words as (first, last), counted from 0. kept: the other words joined by one space.
    """
    keyed = text_key(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    runs = shared_table(_all_runs(keyed, long), "runs")
    # level 1: half windows that repeat
    twice = shared_table(runs.groupBy("anchor").agg(F.sum("n").alias("s")).filter("s > 1").select("anchor"), "anchors")
    runs = shared_table(runs.join(twice, "anchor"), "runs-repeated")
    # level 2: whole stretches that repeat settle their windows
    stretches = shared_table(runs.groupBy("anchor", "stretch").agg(F.sum("n").alias("s"), F.min("_t1").alias("_t1")),
                             "stretches")
    settled = (runs.join(stretches.filter("s > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
               .groupBy("_t1").agg(F.collect_set("stretch").alias("settled")))
    open_ = shared_table(stretches.filter("s = 1").select("anchor").distinct(), "anchors-open")
    asked = (stretches.join(open_, "anchor", "left_semi")
             .groupBy("_t1").agg(F.collect_set("stretch").alias("asked")))
    # one row per text hash; map-side sets hold equal texts once, so a large group of copies does not travel
    texts = keyed.groupBy("_t1").agg(F.collect_set("text").alias("texts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, sets = b.column(0).to_numpy(), _lists(b.column(2))
            flat, owner = _flat(b.column(1))
            for lo, hi in grouped(flat):
                r = Runs(flat[lo:hi], long)
                own = owner[lo + r.owner] if len(r.owner) else r.owner
                chosen = _members(r.stretch, own, sets)
                _, once = np.unique(np.stack([own[chosen].astype(U64), r.stretch[chosen]]), axis=1, return_index=True)
                run, starts = r.windows(chosen[once])
                if len(run):
                    yield pa.RecordBatch.from_arrays([_signed(r.window_hash(starts)), pa.array(key[own[run]])],
                                                     names=["window", "_t1"])

    counted = texts.join(asked, "_t1").mapInArrow(windows, "window long, _t1 long")
    again = counted.groupBy("window").count().filter("count > 1").select("window")
    single = counted.join(again, "window").groupBy("_t1").agg(F.collect_set("window").alias("single"))

    span = StructType().add("first", LongType()).add("last", LongType())
    schema = (StructType().add("_t1", LongType()).add("_t2", LongType()).add("n_words", LongType())
              .add("n_removed", LongType()).add("spans", ArrayType(span)).add("kept", StringType()))
    span_kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, one, more = b.column(0).to_numpy(), _lists(b.column(2)), _lists(b.column(3))
            second = _lists(b.column(4))
            flat, owner = _flat(b.column(1))
            within = np.arange(len(owner)) - np.searchsorted(owner, owner)
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            marked = [len(one[o]) > 0 or len(more[o]) > 0 for o in owner]
            for lo, hi in grouped(flat):
                hot = [i for i in range(lo, hi) if marked[i]]
                gone = dict(zip(hot, _covered([flat[i] for i in hot], owner[hot], one, more, long))) if hot else {}
                for i in range(lo, hi):
                    words, mask = flat[i].split(), gone.get(i)
                    spans = []
                    if mask is not None and mask.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                        spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])]
                    left = _without(words, spans)
                    text = b" ".join(left)
                    out["_t1"].append(int(key[owner[i]]))
                    out["_t2"].append(int(second[owner[i]][within[i]].view(np.int64)))
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(left))
                    out["spans"].append(spans)
                    out["kept"].append(text if keep_text else hashlib.sha256(text).hexdigest().encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["_t1"], pa.int64()), pa.array(out["_t2"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], span_kind),
                 pa.array(out["kept"], pa.binary()).cast(pa.string())], names=[f.name for f in schema.fields])

    return (texts.join(settled, "_t1", "left").join(single, "_t1", "left")
            .withColumn("second", F.transform("texts", lambda t: F.xxhash64(F.lit(1), t)))
            .select("_t1", "texts", "settled", "single", "second").mapInArrow(finish, schema))


def _flat(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All texts of a column of text lists, and the row of each."""
    owner = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return raw_texts(column.flatten()), owner


def _members(values: np.ndarray, owner: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Indices whose value is in its owner's set."""
    out = [np.zeros(0, np.int64)]
    for o in np.unique(owner):
        if len(sets[o]):
            own = np.flatnonzero(owner == o) if len(owner) < 64 else np.arange(*np.searchsorted(owner, [o, o + 1]))
            out.append(own[np.isin(values[own], sets[o])])
    return np.concatenate(out)


def _covered(texts: list[bytes], rows: np.ndarray, settled: list[np.ndarray], single: list[np.ndarray],
             long: int) -> list[np.ndarray]:
    """For each text, which of its words a repeated window covers."""
    r = Runs(texts, long)
    step = np.zeros(len(r.words) + 1, np.int64)
    if len(r.first):
        own = rows[r.owner]
        whole = np.zeros(len(r.first), bool)
        for o in np.unique(r.owner):
            a, z = np.searchsorted(r.owner, [o, o + 1])
            whole[a:z] = np.isin(r.stretch[a:z], settled[rows[o]])
        np.add.at(step, r.first[whole], 1)
        np.add.at(step, r.last[whole] + long, -1)
        rest = np.flatnonzero(~whole & np.array([len(single[o]) > 0 for o in own], bool))
        run, starts = r.windows(rest)
        if len(run):
            h = r.window_hash(starts)
            of = r.owner[run]
            for o in np.unique(of):
                a, z = np.searchsorted(of, [o, o + 1])
                hit = starts[a:z][np.isin(h[a:z], single[rows[o]])]
                np.add.at(step, hit, 1)
                np.add.at(step, hit + long, -1)
    cover = np.cumsum(step[:-1]) > 0
    return [cover[a:z] for a, z in zip(r.offsets[:-1], r.offsets[1:])]


def _without(words: list[bytes], spans: list[dict]) -> list[bytes]:
    out, at = [], 0
    for s in spans:
        out += words[at:s["first"]]
        at = s["last"] + 1
    return out + words[at:]


@sheltered("_t1", "_t2", "kept")
def dedup_substrings(docs: DataFrame, long: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every word dropped that lies in a window of ``long`` words found elsewhere too.

    Changed texts are their kept words joined by one space; others stay as they are. Adds n_words, n_removed,
    spans. Null and empty texts have no words; rows of equal text are copies of each other, whatever
    their ids; windows are judged on the input, so copies all go.
    """
    docs = clear_of(docs, "n_words", "n_removed", "spans")
    out = text_key(docs).join(repeated(docs, long), ["_t1", "_t2"])
    return out.select(*[F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).alias("text")
                        if c == "text" else F.col(c) for c in docs.columns], "n_words", "n_removed", "spans")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated(docs, keep_text=False).select("_t1", "_t2", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return text_key(docs).select("doc_id", "_t1", "_t2").join(found, ["_t1", "_t2"]).drop("_t1", "_t2")
