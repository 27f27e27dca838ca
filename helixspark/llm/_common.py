"""What the operators share: the shared folder, tables in it, Arrow batches, hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is read from the session; a temporary one is made only for a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.environ.setdefault("HELIXSPARK_LOCAL_SHARED", tempfile.mkdtemp(prefix="helixspark-"))
    return f"file://{at}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    spark = SparkSession.getActiveSession()
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/helixspark/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles() -> None:
    """Let Spark drop the shuffle files of plans that are gone, between steps that each shuffle much.

    Python's references keep plans, and with them shuffle files, alive in the JVM; a first pass there only finds them.
    """
    spark = SparkSession.getActiveSession()
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


#: How a worker forgets what tasks of an operator left in it for the next ones, by operator.
_LEFT: dict[str, Callable[[], None]] = {}
#: Seconds without a task after which a worker forgets that too; the timer that counts them.
IDLE = 4.0
_WAITS: list[threading.Timer] = []
_LOCK = threading.Lock()


def trim() -> None:
    """Give a worker's unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def begin(name: str, forget: Callable[[], None] | None = None) -> None:
    """A task of this operator begins in this worker: what the others left goes. ``forget`` drops what this one will leave.

    Spark uses a worker for one plan after another, so that what an operator remembers would add up with what the next one takes.
    """
    with _LOCK:
        while _WAITS:
            _WAITS.pop().cancel()
        others = [x for x in _LEFT if x != name]
        for x in others:
            _LEFT.pop(x)()
        if others or name not in _LEFT:
            trim()
        _LEFT[name] = forget or (lambda: None)


def end() -> None:
    """A task ends in this worker. If no other begins for a while, what it left goes: an idle worker's memory adds up with that of busy ones."""

    def idle() -> None:
        with _LOCK:
            if timer in _WAITS:  # else a task began meanwhile
                _WAITS.remove(timer)
                while _LEFT:
                    _LEFT.popitem()[1]()
                trim()

    trim()
    timer = threading.Timer(IDLE, idle)
    timer.daemon = True
    with _LOCK:
        _WAITS.append(timer)
    timer.start()


def tidy(run: Callable, name: str, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` over a task's batches, in a worker that holds no more than it needs before and after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(name, forget)
        yield from run(batches)
        end()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """The texts of ``as_bytes`` as pieces of about ``most`` bytes, of which one is there at a time, with their ranges."""
    for a, b in pieces([x or 0 for x in pc.binary_length(column).to_pylist()], most):
        yield a, b, as_bytes(column[a:b])


def pieces(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``; a larger item stands alone."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


# Words are hashed in bulk: a polynomial over a random table of bytes, modulo 2**64, then mixed.
_RNG = np.random.default_rng(20240229)
_BASE = np.uint64(int(_RNG.integers(1 << 62)) * 8 + 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _RNG.integers(1 << 63, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n or len(_POWERS[0]) > 4 * max(n, 1 << 22):
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(1 << max(18, n.bit_length()), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes], space: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of all texts' words in order, A-Z as a-z: 64-bit hash, index of the text, start and end within the text's bytes.

    With ``heads``, also a row for each of those lengths: hash of the word's first bytes, 0 where it isn't longer.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = space[buffer]
    gap[-1] = True
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    begins, ends = edges[::2], edges[1::2]
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    gap[offsets[1:] - 1] = True
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, *[np.zeros((len(heads), 0), np.uint64)] * bool(heads)
    up, down = _powers(len(buffer))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_LOWER[buffer] * up)])
        hashes = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros((len(heads), len(begins)), np.uint64)
        for k, n in enumerate(heads):
            longer = ends - begins > n
            first[k, longer] = mix((total[begins[longer] + n] - total[begins[longer]]) * down[begins[longer]] + np.uint64(n + 1))
    where = np.searchsorted(offsets, begins, "right") - 1
    return hashes, where, begins - offsets[where], ends - offsets[where], *[first] * bool(heads)


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's set of word runs of that size as sorted 64-bit hashes; of fewer words, the run of all; else empty."""
    hashes, where, _, _ = words(texts)
    cuts = np.searchsorted(where, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        runs = hashes[: max(0, len(hashes) - size + 1)].copy()
        for k in range(1, size):
            runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(runs)])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            else:
                run = hashes[a:b][:1].copy()
                for k in range(a + 1, b):
                    run = mix(run * np.uint64(0x9E3779B97F4A7C15) + hashes[k])
                out.append(run)
    return out
