"""Helpers shared by the operators: shared-folder tables, Arrow text access, vectorised word hashes.

Text rules used throughout: a null text is an empty text; ``WORD`` words are runs of bytes
other than ASCII white space, so ``bytes.split()`` yields exactly them; ``bytes.lower()``
lower-cases A-Z alone.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
SLICE_BYTES = 1 << 20
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (spark.checkpoint.dir) and read back.

    Cuts the lineage: later stages reread the files, also when executors are lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "tidewater.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidewater_shipped = True


def small_batches(query: Callable) -> Callable:
    """For a query or stage: Python tasks have this package, and take BATCH_ROWS rows at a time, so that long
    texts fit beside each other."""
    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
            spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
        return query(spark, *args, **kwargs)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns an operator is about to add (clashing names give way)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def sheltered(*names: str) -> Callable:
    """For an operator on ``docs``: columns of these names, which it uses inside, pass through untouched."""
    taken = {n.lower() for n in names}

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            hidden = {c: f"_kept{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in taken}
            out = operator(docs.withColumnsRenamed(hidden), *args, **kwargs)
            return out.withColumnsRenamed({h: c for c, h in hidden.items()})
        return run

    return wrap


def raw_texts(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes; null gives empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(texts: Iterable[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together (one text at least)."""
    start = size = i = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if size:
        yield start, i + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (full avalanche), in place on a copy."""
    x = x.copy()
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _POWERS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)), {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (kept, grown by doubling)."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        base = _BASE[which]
        inverse = U64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, U64), np.full(size, inverse, U64)
        up[0] = down[0] = U64(1)
        have = _POWERS[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of ``data`` cut at white space, of about SLICE_BYTES; a longer word stays whole."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        part = data[at:at + SLICE_BYTES]
        cut = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if not cut:
            found = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
                     if (p := data.find(c, at + SLICE_BYTES)) >= 0]
            cut = (min(found) if found else len(data)) - at
        yield data[at:at + cut]
        at += cut
    yield data[at:]


def _spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return a, edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the offsets of each text's words."""
    parts, counts = [], np.zeros(len(texts) + 1, np.int64)
    for lo, hi in grouped(texts):
        joined = b"\n".join(texts[lo:hi])
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        at = 0
        for piece in _slices(joined):
            a, first, last = _spans(piece)
            if len(first):
                up, down = _powers(len(a) + 1, 0)
                sums = np.zeros(len(a) + 1, U64)
                np.cumsum(_BYTE[a] * up[:len(a)], out=sums[1:])
                parts.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64)))
                of = np.searchsorted(ends, first + at, side="right")
                counts[lo + 1:hi + 1] += np.bincount(of, minlength=hi - lo)[:hi - lo]
            at += len(piece)
    words = np.concatenate(parts) if parts else np.zeros(0, U64)
    return words, np.cumsum(counts)


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive entries (across texts too: mask by offsets)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(len(words) + 1, which)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + U64(k))


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
