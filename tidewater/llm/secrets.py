"""Secret scan: three fixed patterns, and a battery of randomness tests for whatever else looks like an encoded key.

A candidate is a run of at least SHORTEST encoding characters outside the patterns' spans that is not a number. Its
encoding is the smallest alphabet that holds it. The battery asks whether it may be random in that alphabet:

* chi-squared: are the characters equally frequent? (X2 = (k/n)(n + 2C) - n, where C counts pairs of equal characters);
* runs: as many runs above and below the alphabet's middle as independent characters give;
* serial correlation: no correlation between neighbours.

Fisher's method joins the three; a run for which the joint level is below RANDOM is not random. Short runs pass that
easily, so a second question decides: could ordinary text of this length have so few pairs of equal characters? C's mean and
variance under the corpus's own character frequencies give that level, and Benjamini-Hochberg at rate ALPHA, over the
distinct candidates of all documents, in each class of encoding and length by itself, gives each class its limit.
So a longer run needs no luck, and a class full of ordinary words admits none of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import clear_of, raw_texts, read, shared_table, sheltered

SHORTEST, RANDOM, ALPHA = 16, 0.001, 0.01
MOST_BIN = 600           # levels are counted in bins of 1 / 20 of a power of ten, down to 1e-30
KINDS = ("assign", "access", "hex", "random")

# The patterns, and the least number of characters of what they find.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED, ACCESS = 8, 16

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {  # smallest first
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "letters": LOWER, "LETTERS": UPPER, "base32": UPPER + "234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_"}


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches in code points, by start and kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGNED]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


@cache
def _places() -> dict[str, np.ndarray]:
    """Per encoding the place of each ASCII character in its alphabet, or -1."""
    out = {}
    for name, letters in ALPHABETS.items():
        out[name] = np.full(128, -1, np.int64)
        out[name][np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return out


def encoding_of(run: str) -> tuple[str, np.ndarray] | None:
    """The smallest alphabet that holds the run (without = at its end), and the characters' places in it; None for a
    number or a mixture of + / with - _."""
    body = np.frombuffer(run.rstrip("=").encode(), np.uint8)
    if (body <= 57).all() and (body >= 48).all():
        return None
    for name, places in _places().items():
        values = places[body]
        if values.min() >= 0:
            return name, values
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """The upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return math.erfc(z / math.sqrt(2)) / 2


def battery(values: np.ndarray, k: int) -> tuple[int, float]:
    """(pairs of equal characters, joint level of the three tests) of a run over an alphabet of ``k``."""
    n = len(values)
    counts = np.bincount(values, minlength=k)
    pairs = int((counts * (counts - 1) // 2).sum())
    levels = [_chi_tail(k / n * (n + 2 * pairs) - n, k - 1)]
    above = values >= k // 2
    p = 1 - (k // 2) / k
    share = 2 * p * (1 - p)
    changes = int((above[1:] != above[:-1]).sum())
    # changes between independent neighbours: mean (n-1)s, and neighbouring changes are dependent unless p is one half
    spread = (n - 1) * share * (1 - share) + 2 * (n - 2) * (p * (1 - p) - share * share)
    levels.append(_two_sided((changes - (n - 1) * share) / math.sqrt(max(spread, 1e-9))))
    x = values - values.mean()
    whole = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / whole if whole else 1.0
    levels.append(_two_sided((serial + 1 / n) * math.sqrt(n)))
    return pairs, _chi_tail(-2 * sum(math.log(max(x, 1e-300)) for x in levels), 6)


def length_class(n: int) -> int:
    """Two classes per doubling of the length."""
    return int(2 * math.log2(n))


def ordinary_level(pairs: int, n: int, shares: np.ndarray) -> float:
    """The chance that ``n`` independent characters of these shares have at most ``pairs`` pairs of equal ones."""
    two, three = float((shares ** 2).sum()), float((shares ** 3).sum())
    all_pairs = n * (n - 1) / 2
    spread = all_pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)
    z = (pairs + 0.5 - all_pairs * two) / math.sqrt(max(spread, 1e-9))
    return math.erfc(-z / math.sqrt(2)) / 2


def level_bin(level: float) -> int:
    """The level's bin: it is at most 10 ** (-bin / 20)."""
    return min(MOST_BIN, int(-20 * math.log10(max(level, 1e-300))))


def limits(counts: dict[tuple[str, int], dict[int, int]], alpha: float = ALPHA) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg per class on binned levels: the least bin that is admitted (classes that admit none are left out)."""
    out = {}
    for name, bins in counts.items():
        every, at_least = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            at_least += bins[b]
            if 10 ** (-b / 20) * every <= alpha * at_least:
                out[name] = b
    return out


def character_shares(docs: DataFrame) -> dict[str, np.ndarray]:
    """Per encoding, the shares of its characters among those of all texts (each counted once more than it occurs)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for text in raw_texts(b.column(0)):
                total += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(128), pa.int32()), pa.array(total[:128])], names=["c", "n"])

    total = np.ones(128)
    for c, n in docs.select("text").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n")).collect():
        total[c] += float(n)
    chosen = {name: total[np.frombuffer(a.encode(), np.uint8)] for name, a in ALPHABETS.items()}
    return {name: x / x.sum() for name, x in chosen.items()}


_SPAN = StructType().add("start", LongType()).add("end", LongType()).add("kind", StringType()).add("encoding", StringType())
_SPAN_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("encoding", pa.string())])
_TEST = "array<struct<start: bigint, end: bigint, encoding: string, class: int, n: bigint, pairs: bigint, mark: bigint>>"
_TEST_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("class", pa.int32()),
                         ("n", pa.int64()), ("pairs", pa.int64()), ("mark", pa.int64())])


def candidates(text: str, fixed: list[tuple[int, int, str]]) -> list[tuple]:
    """Runs outside the fixed spans that pass the battery: (start, end, encoding, class, n, pairs, hash of the run)."""
    covered: list[list[int]] = []   # the fixed spans, joined where they overlap
    for s, e, _ in fixed:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    ends = [e for _, e in covered]
    out = []
    for m in _RUN.finditer(text):
        i = bisect_right(ends, m.start())
        if i < len(covered) and covered[i][0] < m.end():
            continue
        known = encoding_of(m.group())
        if known is None:
            continue
        name, values = known
        pairs, level = battery(values, len(ALPHABETS[name]))
        if level >= RANDOM:
            out.append((m.start(), m.end(), name, length_class(len(values)), len(values), pairs, _mark(m.group())))
    return out


def _mark(run: str) -> int:
    return int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "little", signed=True)


@sheltered("_fixed", "_tested")
def find_secrets(docs: DataFrame, carry: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) and ``secrets``: (start, end, kind, encoding) of every span in
    code points, end exclusive, by start and then kind in the order of KINDS.

    A null or empty text has none. Rows are scanned one by one, repeated and null ids too; the limits of the battery
    come from the distinct candidates of all rows, so that copies do not vote twice. A row of an empty table does not
    arise. A column named secrets is replaced.
    """
    docs = clear_of(docs, "secrets")
    carried = [c for c in docs.columns if carry is None or c in carry]
    shares = character_shares(docs)
    text_at, at = docs.columns.index("text"), [docs.columns.index(c) for c in carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed, tested = [], []
            for text in b.column(text_at).cast(pa.string()).to_pylist():
                own = fixed_spans(text or "")
                fixed.append([(s, e, k, None) for s, e, k in own])
                tested.append(candidates(text or "", own))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in at], _structs(fixed, _SPAN_ARROW), _structs(tested, _TEST_ARROW)],
                names=[*carried, "_fixed", "_tested"])

    schema = StructType([docs.schema.fields[i] for i in at]).add("_fixed", ArrayType(_SPAN)).add(
        "_tested", StructType.fromDDL(f"x {_TEST}")["x"].dataType)
    scanned = shared_table(docs.mapInArrow(scan, schema), "secrets")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([level_bin(ordinary_level(r["pairs"], r["n"], shares[r["encoding"]])) for r in rows],
                                                    pa.int32())], names=["encoding", "class", "bin"])

    # distinct candidates; then one row per encoding, class of length and bin
    tests = scanned.select(F.explode("_tested").alias("t")).select("t.encoding", "t.class", "t.n", "t.pairs", "t.mark").distinct()
    table: dict[tuple[str, int], dict[int, int]] = {}
    for r in (tests.select("encoding", "class", "n", "pairs").mapInArrow(bins, "encoding string, class int, bin int")
              .groupBy("encoding", "class", "bin").count().collect()):
        table.setdefault((r.encoding, r["class"]), {})[r.bin] = r["count"]
    least = limits(table, alpha)
    fixed_at, tested_at = len(carried), len(carried) + 1

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fixed, tested in zip(b.column(fixed_at).to_pylist(), b.column(tested_at).to_pylist()):
                spans = [(s["start"], s["end"], s["kind"], None) for s in fixed]
                for t in tested:
                    limit = least.get((t["encoding"], t["class"]))
                    if limit is not None and level_bin(ordinary_level(t["pairs"], t["n"], shares[t["encoding"]])) >= limit:
                        spans.append((t["start"], t["end"], KINDS[3], t["encoding"]))
                out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(carried))], _structs(out, _SPAN_ARROW)],
                                             names=[*carried, "secrets"])

    schema = StructType([docs.schema.fields[i] for i in at]).add("secrets", ArrayType(_SPAN))
    return scanned.mapInArrow(decide, schema)


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    names = [kind.field(i).name for i in range(kind.num_fields)]
    return pa.array([[dict(zip(names, x)) for x in row] for row in rows], pa.list_(kind))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    fixed = F.filter("secrets", lambda s: s["kind"] != KINDS[3])

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return out.select("doc_id", *map(number, KINDS), F.sha2(joined(fixed), 256).alias("base_sha256"),
                      joined(F.col("secrets")).alias("spans"))
