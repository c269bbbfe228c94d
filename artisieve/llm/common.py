"""Shared helpers: staged tables, word reading and 64-bit hashing."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="artisieve-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables staged inside, but for those staged with ``keep``, which go with the scratch around
    it, if any. Nothing lazy may outlive it that reads the others."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Inside, the session's setting ``name`` is ``value``."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_released(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Inside, Spark removes the shuffle files of a finished job at its end, not when the driver next collects garbage.
    For operators that stage all they read again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Inside, jobs hand Python batches of about 4 MB, not of 10,000 rows whatever their length (64 MB at most): each batch
    is in memory on both sides, and twice where the next is read. For operators that run their jobs inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/artisieve/{label}-{uuid.uuid4().hex}"
    if len(inside := _scratch.get()) > keep:
        inside[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A 64-bit value for each byte; those of A-Z are those of a-z, blanks have none.
VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
VALUE[65:91] = VALUE[97:123]
VALUE[SPACE] = 0


def word_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, bounds, inside, first): the bytes of all texts, where each text begins and the last one ends, and which bytes
    are in words and begin one. A null text is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1] or bytes(8), kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]  # a word does not go on from one text into the next
    first[cuts] = inside[cuts]
    return raw, bounds, inside, first


def word_hashes(texts: pa.Array, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a 64-bit hash of each word of all texts (A-Z lowered), and the places where each text's words
    end among them, after a leading 0. A null text has no words. A word's hash is a polynomial in its bytes,
    computed for about ``most`` bytes at a time, whole words each."""
    raw, bounds, _, first = word_bytes(texts)
    starts = np.flatnonzero(first)
    edges, out = np.append(starts, len(raw)), np.zeros(len(starts), np.uint64)
    powers, at = np.ones(1, np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(int(np.searchsorted(edges, edges[at] + most, side="right")) - 1, at + 1)
            lo, hi = int(edges[at]), int(edges[to])
            size = np.diff(edges[at : to + 1])
            if (longest := int(size.max())) > len(powers):
                powers = np.cumprod(np.append(np.uint64(1), np.full(longest - 1, MULTIPLIER)))
            place = np.arange(hi - lo, dtype=np.int32) - np.repeat((edges[at:to] - lo).astype(np.int32), size)
            out[at:to] = np.add.reduceat(VALUE[raw[lo:hi]] * powers[place], edges[at:to] - lo)
            at = to
    return mix64(out), np.searchsorted(starts, bounds)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words, by doubling; a shorter non-empty text is one window."""
    if not len(words):
        return words
    k, odd = min(k, len(words)), 0x9E3779B97F4A7C15
    out, have, block, size = words[:0], 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                n = len(words) - have - size + 1
                out = out[:n] * np.uint64(pow(odd, size, 1 << 64)) + block[have : have + n] if have else block
                have += size
            if have == k:
                return mix64(out + np.uint64(k))
            block = block[:-size] * np.uint64(pow(odd, size, 1 << 64)) + block[size:]
            size *= 2


def sliding(x: np.ndarray, window: int, least: np.ufunc) -> np.ndarray:
    """``least`` over each run of ``window`` neighbours, by doubling."""
    size = 1
    while size < window:
        step = min(size, window - size)
        x = least(x[: len(x) - step], x[step:])
        size += step
    return x


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some run of ``window`` neighbours (all of them on ties)."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    least = np.concatenate([edge, sliding(hashes, window, np.minimum), edge])
    return np.flatnonzero(sliding(least, window, np.maximum) == hashes)


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch, each of about ``most`` bytes, so that long texts never pile up in Python."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
