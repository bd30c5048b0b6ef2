"""MinHash near-dedup by an LSH forest.

Each distinct word sequence is a node with COORDS minhashes of its shingle set. A tree orders all nodes by
its own sequence of coordinates; nodes that share their first DEPTH coordinates in a tree are
neighbours in that order and form a region. Depth adapts to the region: one of up to REGION nodes is compared as it
is; in a larger one all nodes are compared with its pivot, and it is cut by further coordinates, down
to DEPTHS[-1]. Sketches (a byte per coordinate) estimate a pair's similarity. Links only matter as components, so first a
spanning forest of each region's promising pairs is confirmed on the full shingle sets, best estimates first; then every
promising pair whose nodes are still in different components is. The pivots of large regions are
chosen once more, by most links.

Pairs, links and components stay in Spark tables; no task gathers more than a region of REGION nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, mix, raw_texts, read, sheltered, shared_table, window_hashes, word_hashes

SHINGLE = 5
COORDS = 512
TREES = 24
DEPTH = 4                          # TREES * DEPTH coordinates head the trees, each once
DEPTHS = (4, 6, 8, 12, 16, 24)     # of regions too large to compare
REGION = 1024                      # nodes a task compares at once
PERCENT = 75                       # link: 100 * shared >= PERCENT * united
LOW = 0.67                         # estimates that may reach it (512 coordinates: 0.019 of spread)
TASK_LINKS = 200_000               # links joined in one task, about
U64, U32 = np.uint64, np.uint32

_RNG = np.random.default_rng(77)
_FACTORS = _RNG.integers(1 << 28, 1 << 31, COORDS, dtype=np.uint32) * U32(2) + U32(1)
_ORDERS = np.array([[*range(t * DEPTH, t * DEPTH + DEPTH),
                     *(_RNG.permutation([c for c in range(COORDS) if c // DEPTH != t]))] for t in range(TREES)])


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, sequences): each text's sorted distinct shingles, and a hash of all its words in
    order (A-Z lower-cased). A text of fewer than SHINGLE words has its whole sequence as its shingle."""
    words, at = word_hashes([t.lower() for t in texts])
    n = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), n)
    h = window_hashes(words, SHINGLE)
    inside = owner[:len(h)] == owner[SHINGLE - 1:] if len(h) else np.zeros(0, bool)
    place = np.arange(len(words), dtype=U64) - np.repeat(at[:-1], n).astype(U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words + mix(place + U64(1))))])
    whole = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(U64))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    value = np.concatenate([h[inside], whole[short]])
    own = np.concatenate([owner[:len(h)][inside], short])
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(texts) + 1)), whole


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, COORDS) least products; empty sets have zeros."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((COORDS, len(offsets) - 1), U32)
    if len(filled):
        short, start = (values >> U64(32)).astype(U32), offsets[filled]
        for c in range(COORDS):
            out[c, filled] = np.minimum.reduceat(short * _FACTORS[c], start)
    return out.T


def _region_keys(least: np.ndarray) -> np.ndarray:
    """(sets, TREES): a hash of each tree's first DEPTH coordinates."""
    key = np.tile(mix(np.arange(1, TREES + 1, dtype=U64)), (len(least), 1))
    for d in range(DEPTH):
        key = mix(key ^ mix(least[:, _ORDERS[:, d]].astype(U64) + (U64(d) << U64(40))))
    return key


def _node_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, node, n, keys, sketch) of every row; node is null without words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw_texts(b.column(2))
            for lo, hi in grouped(texts):
                values, offsets, whole = shingle_sets(texts[lo:hi])
                least, n = minhashes(values, offsets), np.diff(offsets)
                keys = _region_keys(least).view(np.int64)
                sketch = np.ascontiguousarray((least * U32(2654435761)) >> U32(24)).astype(np.uint8)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     pa.array(whole.view(np.int64), mask=none), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TREES, dtype=np.int32)),
                                              pa.array(keys.ravel())),
                     pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["doc_id", "_th", "node", "n", "keys", "sketch"])

    return docs.select("doc_id", "_th", "text").mapInArrow(
        emit, "doc_id long, _th long, node long, n long, keys array<long>, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of sketches, corrected for bytes that agree by chance."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes that allow the threshold."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected index of each of ``size`` nodes."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _chosen_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray | None = None,
                  turn: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Promising pairs of whole regions (rows sorted by key and node): a spanning forest of them, or, with
    labels, all whose labels differ. Then a pair is left out where an earlier tree's region (``own``: each row's
    regions by tree, 0 for none; ``turn``: the trees before this one) has it too."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.append(start[1:], len(key))
    size = end - start
    after = np.repeat(end, size) - np.arange(len(key)) - 1      # later rows of the same region
    i = np.repeat(np.arange(len(key)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    ok = _fits(n[i], n[j])
    if label is not None:
        ok &= label[i] != label[j]
    i, j = i[ok], j[ok]
    if own is not None and len(i):
        earlier = np.arange(TREES)
        again = np.concatenate([((own[i[s:s + 16384]] == own[j[s:s + 16384]]) & (own[i[s:s + 16384]] != 0)
                                 & (earlier < turn[i[s:s + 16384], None])).any(axis=1) for s in range(0, len(i), 16384)])
        i, j = i[~again], j[~again]
    est = np.concatenate([_alike(sketch[i[s:s + 16384]], sketch[j[s:s + 16384]]) for s in range(0, len(i), 16384)]
                         ) if len(i) else np.zeros(0)
    i, j, est = i[est >= LOW], j[est >= LOW], est[est >= LOW]
    if label is None and len(i):
        chosen, part, left = np.zeros(0, np.int64), np.arange(len(key)), np.arange(len(i))
        while len(left):  # each part's best pair to another part, until no pair joins two parts
            a, b = part[i[left]], part[j[left]]
            both, edge = np.concatenate([a, b]), np.concatenate([left, left])
            order = np.lexsort((edge, -est[edge], both))
            first = np.concatenate(([True], np.diff(both[order]) > 0))
            chosen = np.union1d(chosen, edge[order][first])
            part = _roots(len(key), i[chosen], j[chosen])
            left = left[part[i[left]] != part[j[left]]]
        i, j = i[chosen], j[chosen]
    return node[i], node[j]


def _compare_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, sketch, perhaps label, turn, own), sorted: a batch's last region waits for the next batch."""
    held = None

    def own_regions(lists: pa.Array) -> np.ndarray:
        out = np.zeros((len(lists), TREES), np.int64)
        each = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.where(lists.is_valid().to_numpy(zero_copy_only=False),
                                                        np.diff(lists.offsets.to_numpy()), 0))
        out[row, each.field(0).to_numpy()] = each.field(1).to_numpy()
        return out

    def rows_of(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3)),
                *[c.to_numpy() for c in b.columns[4:6]], *map(own_regions, b.columns[6:])]

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _chosen_pairs(*rows)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for b in batches:
        rows = rows_of(b)
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        for s, e in _blocks(rows[0][:cut]):
            yield pairs([x[s:e] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield pairs(held)


def _blocks(key: np.ndarray, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of whole regions of about ``rows`` rows."""
    s = 0
    while s < len(key):
        e = min(s + rows, len(key))
        e = len(key) if e == len(key) else int(np.searchsorted(key, key[e - 1], side="right"))
        yield s, e
        s = e


def _compared(regions: DataFrame, *more: str) -> DataFrame:
    return (regions.select("key", "node", "n", "sketch", *more).repartition("key").sortWithinPartitions("key", "node")
            .mapInArrow(_compare_regions, "a long, b long"))


def _with_pivot(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs of each member with its region's pivot that may reach the threshold.

    ``pivots``: (key, p, pn, ps). A large region's rows are spread by the join, not gathered.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, pivot = b.column(0).to_numpy(), b.column(3).to_numpy()
            ok = _fits(b.column(1).to_numpy(), b.column(4).to_numpy()) & (node != pivot)
            ok &= _alike(_matrix(b.column(2)), _matrix(b.column(5))) >= LOW
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, pivot)[ok]), pa.array(np.maximum(node, pivot)[ok])],
                                             names=["a", "b"])

    return (members.join(pivots, "key").select("node", "n", "sketch", "p", "pn", "ps").mapInArrow(keep, "a long, b long"))


def _deeper(members: DataFrame, depth: int, to: int) -> DataFrame:
    """Members with their regions cut by the coordinates from ``depth`` up to ``to`` of their tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tree, sketch = b.column(0).to_numpy().view(U64), b.column(1).to_numpy(), _matrix(b.column(4))
            for d in range(depth, to):
                key = mix(key ^ mix(sketch[np.arange(len(key)), _ORDERS[tree, d]].astype(U64) + U64(256 * d)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns[1:]], names=b.schema.names)

    return members.select("key", "tree", "node", "n", "sketch").mapInArrow(
        cut, "key long, tree int, node long, n long, sketch binary")


def _counted(members: DataFrame) -> DataFrame:
    """Members of regions of two or more, with the region's size."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "key")


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(regions to compare, regions too large if any) of all depths, from (node, n, keys, sketch)."""
    heads = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    members = shared_table(_counted(heads).join(nodes.select("node", "n", "sketch"), "node")
                           .select("key", "tree", "node", "n", "sketch", "size"), "regions")
    small, large = [members.filter(F.col("size") <= REGION).withColumn("turn", F.col("tree"))], []
    members = members.filter(F.col("size") > REGION)
    for depth, to in zip(DEPTHS, (*DEPTHS[1:], 0)):
        if members.isEmpty():
            break
        large.append(members)
        if to:
            members = shared_table(_counted(_deeper(members, depth, to)), "regions")
            small.append(members.filter(F.col("size") <= REGION).withColumn("turn", F.lit(TREES)))
            members = members.filter(F.col("size") > REGION)
    return _union(small), _union(large) if large else None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def first_pairs(small: DataFrame, large: DataFrame | None) -> DataFrame:
    """Pairs a < b to confirm first: spanning forests of regions, and large regions' members with their least node."""
    pairs = _compared(small)
    if large is not None:
        pairs = pairs.unionByName(_with_pivot(large, large.groupBy("key").agg(
            F.min("node").alias("p"), F.min_by("n", "node").alias("pn"), F.min_by("sketch", "node").alias("ps"))))
    return shared_table(pairs.distinct(), "pairs")


def later_pairs(small: DataFrame, large: DataFrame | None, links: DataFrame, labels: DataFrame) -> DataFrame:
    """All promising pairs between components: within regions, and of large ones' members with the member of most links."""
    def labelled(members: DataFrame) -> DataFrame:
        return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    own = (small.filter(F.col("turn") < TREES).groupBy("node").agg(F.collect_list(F.struct("tree", "key")).alias("own")))
    pairs = _compared(labelled(small).join(own, "node", "left"), "label", "turn", "own")
    if large is not None:
        degree = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(F.count("*").alias("links"))
        m = labelled(large).join(degree, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        rank = F.struct("links", "node")
        hub = m.groupBy("key").agg(F.max_by("node", rank).alias("p"), F.max_by("n", rank).alias("pn"),
                                   F.max_by("sketch", rank).alias("ps"), F.max_by("label", rank).alias("pl"))
        far = m.join(hub.select("key", "pl"), "key").filter("label != pl").select("key", "node", "n", "sketch")
        pairs = pairs.unionByName(_with_pivot(far, hub.drop("pl")))
    return pairs.distinct()


def _sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, _th): the full sorted sets as packed 64-bit hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            texts, node = raw_texts(b.column(1).flatten()), b.column(0).to_numpy()
            for lo, hi in grouped(texts):
                values, offsets, whole = shingle_sets(texts[lo:hi])
                mine = [i for i in range(hi - lo) if whole[i].view(np.int64) == node[owner[lo + i]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[owner[lo + np.array(mine, int)]]),
                     pa.array([values[offsets[i]:offsets[i + 1]].tobytes() for i in mine], pa.binary())],
                    names=["node", "shingles"])

    texts = keyed.groupBy("_th").agg(F.collect_set("text").alias("texts"))  # equal texts once, before they move
    return texts.join(wanted, "_th").select("node", "texts").mapInArrow(emit, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, U64), np.frombuffer(y, U64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * shared >= PERCENT * (len(s) + len(t) - shared))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = sets.withColumnRenamed("shingles", "sa")
    return (pairs.join(named.withColumnRenamed("node", "a"), "a")
            .join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
            .select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, of all linked nodes.

    Each task first joins its own links and keeps one per node, to the least node it knows; while there are several
    tasks' worth, rounds over tables follow: a node takes the least label around, and then that label's label, so that
    long chains close in few rounds.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _roots(len(nodes), at[:len(a)], at[len(a):])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])

    tasks = -(-links.count() // TASK_LINKS)
    labels = links.repartition(max(1, tasks)).mapInArrow(contract, "node long, label long")
    if tasks <= 1:
        return shared_table(labels, "labels")
    edges = labels.filter("node != label")
    both = shared_table(edges.union(edges.select("label", "node")).toDF("node", "near").distinct(), "links")
    labels = shared_table(both.groupBy("node").agg(F.min("near").alias("m"))
                          .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"node": "near", "label": "l"}), "near")
                .groupBy("node").agg(F.min("l").alias("l")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = shared_table(step.join(jump, "label", "left")
                           .select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old != label").isEmpty():
            return labels


def with_components(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, n, label): every row with its shingle count and its component (null without words)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text"))
    rows = shared_table(_node_rows(keyed), "nodes")
    nodes = shared_table(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("_th").alias("_th"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch")), "classes")
    small, large = forest(nodes)
    pairs = first_pairs(small, large)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if large is not None:  # their members may meet another pivot
        ends = ends.union(large.select("node"))
    sets = shared_table(_sets(keyed, nodes.select("node", "_th").join(ends.distinct(), "node", "left_semi")), "sets")
    links = shared_table(confirmed(pairs, sets), "links")
    labels = components(links)
    more = later_pairs(small, large, links, labels).join(pairs, ["a", "b"], "left_anti")
    fresh = shared_table(confirmed(more, sets), "links")
    if not fresh.isEmpty():
        labels = components(labels.filter("node != label").toDF("a", "b").union(fresh))
    return rows.select("doc_id", "_th", "n", "node").join(labels, "node", "left").select(
        "doc_id", "_th", "n", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, _th, n_shingles, component_id (least doc_id reachable) and kept (it is that document).

    Documents without words are linked with nothing. A null doc_id can be linked but is no component's id,
    unless all of it have none; such rows are not marked kept. Rows of one id and text are copies of each other.
    """
    rows = shared_table(with_components(docs), "components")
    least = shared_table(rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least, "label", "left")
    own = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "_th", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


@sheltered("_th", "_id", "_h")
def dedup_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: least doc_id (nulls last), then least text hash.

    Rows without words all stay; of rows equal in id and text one stays.
    """
    rows = shared_table(with_components(docs), "components")
    first = (rows.filter("label IS NOT NULL")
             .groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_th")).alias("k"))
             .select(F.col("k.doc_id").alias("_id"), F.col("k._th").alias("_h")).distinct())
    keyed = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = (keyed.filter(worded).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left_semi")
            .dropDuplicates(["doc_id", "_th"]))
    return kept.unionByName(keyed.filter(~worded)).select(*docs.columns)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("_th")
