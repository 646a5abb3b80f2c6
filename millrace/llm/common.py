"""Shared pieces of the corpus operators: scratch tables, row keys and vectorised word hashing.

Row keys.  ``with_key`` gives every row a unique long key.  A unique, non-null integer id is used as it is;
otherwise (null or repeated ids) the rows are numbered once, in the order of their ids with nulls last, and
written to a scratch table, so repeated rows are separate documents everywhere and later scans agree.  Rows with
one and the same id are told apart by their place in the written input, so that they sort into many tasks.

Hashes.  Strings and runs of words are named by Rabin-Karp sums modulo the prime 2^61 - 1 to a random base: two
different strings of n symbols share a name with a chance of n / 2^61 at most, whatever they look like (sums modulo
2^64 collide on Thue-Morse strings for every base).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Text is taken in slices of about so many bytes, which bounds the numpy temporaries.
SLICE = 1 << 19

_written: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/millrace-scratch"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Removes scratch tables that no later step reads."""
    for df in tables:
        path = df.__dict__.pop("_scratch", None) if df is not None else None
        if path:
            remove_path(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc.sc().isStopped():
                continue
            remove_path(spark, path)
        except Exception:  # the session may be gone at exit
            return


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only, so that further columns cannot clash with internal names."""
    return df.select(*cols)


def input_bytes(df: DataFrame) -> int:
    """The size of the tables that df is made from; the optimizer's own guess of a join's size can be far too large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts_for(df: DataFrame, each: int) -> int:
    """How many buckets of about `each` scanned bytes df needs."""
    size = min(input_bytes(df), 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 22, size // each + 1))


def free_name(taken, name: str) -> str:
    """name, or name with underscores before it that no column has (names differ by more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def with_key(df: DataFrame, id_col: str, name: str = "keyed", key: str = "_key") -> DataFrame:
    """df with a unique long column `key`, which df must not have; see the module's text."""
    ids = F.col(f"`{id_col}`")
    kind = df.schema[id_col].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        odd = df.groupBy(ids.alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("id").isNull() | (F.col("n") > 1))
        if odd.isEmpty():
            return df.withColumn(key, ids.cast("long"))
    # Written before it is sorted, so that a row's place is the same for every later read.
    placed = written(df.withColumn(key, F.monotonically_increasing_id()), f"{name}-placed")
    out = written(placed.orderBy(ids.asc_nulls_last(), key).withColumn(key, F.monotonically_increasing_id()), name)
    release(placed)
    return out


def even_ids(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that Spark's hash partitioning deals evenly to the shuffle's tasks; at random, some tasks would get
    several buckets and others none. Where there are many buckets for each task, chance is even enough."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n >= 32 * tasks:
        return np.arange(n)
    each = -(-n // tasks)
    rows = spark.range(0, (each + 8) * tasks * 4, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).collect()
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["task"], []).append(r["id"])
    ids = [found[t][i] for i in range(each) for t in sorted(found) if i < len(found[t])]
    spare = (each + 8) * tasks * 4
    return np.array((ids + list(range(spare, spare + n)))[:n], np.int64)


# ---------------------------------------------------------------------------------------------------
# Words and hashes of a slice of texts, without a Python loop over words.

_U = np.uint64
#: The prime 2^61 - 1 and random bases below it.
_P = _U((1 << 61) - 1)
_BASE = 0x1A6B3F2C9D5E7081
_SECOND = 0x0C3D91E57F2A6B4F
_WORD_BASE = 0x15F7C2E80B94D36D
_M31, _M30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
_S61, _S31, _S30, _1 = _U(61), _U(31), _U(30), _U(1)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any x below 2^64."""
    x = (x & _P) + (x >> _S61)
    return np.minimum(x, x - _P)  # x - p wraps to a huge number where x is smaller


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, from products of halves; 2^61 counts as 1."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _1) + (middle >> _S30) + ((middle & _M30) << _S31) + a0 * b0)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        have = tuple(_powers(x, size) for x in (base, pow(base, -1, int(_P))))
        if size <= 4 * SLICE:
            _POWERS[base] = have
    return have


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    done = 1
    while done < n:
        out[done : 2 * done] = mulmod(out[: min(done, n - done)], np.array([pow(base, done, int(_P))], _U))
        done *= 2
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp prefix sums as low and high parts, for span_hash. values: bytes, or anything below 2^61."""
    n = len(values)
    up = powers(base, n)[0][:n]
    low, high = np.zeros(n + 1, _U), np.zeros(n + 1, _U)
    if values.dtype == np.uint8 and n < 1 << 22:  # products of halves of less than 2^40 add up to less than 2^62
        wide = values.astype(_U) + _1
        np.cumsum(wide * (up & _M31), out=low[1:])
        np.cumsum(wide * (up >> _S31), out=high[1:])
    else:
        terms = mulmod(values.astype(_U) + _1 if values.dtype == np.uint8 else values, up)
        np.cumsum(terms & _M31, out=low[1:])
        np.cumsum(terms >> _S31, out=high[1:])
    return low, high


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The sum for values[start:end] alone, below 2^61."""
    low, high = _reduced(prefix[0][end] - prefix[0][start]), _reduced(prefix[1][end] - prefix[1][start])
    shifted = ((high & _M30) << _S31) + (high >> _S30)
    return mulmod(_reduced(low + shifted), powers(base, len(prefix[0]))[1][start])


def slices(texts: pa.Array):
    """(first row, last row, bytes, offsets) of consecutive rows of about SLICE bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1
        last = min(n, max(row + 1, last))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    prefix = prefix_hash(data, _BASE)
    return mix(span_hash(prefix, starts, ends, _BASE) + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, by start; rows cross texts, the caller drops those."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    prefix = prefix_hash(hashes >> _U(3), _WORD_BASE)
    at = np.arange(len(hashes) - n + 1)
    return mix(span_hash(prefix, at, at + n, _WORD_BASE))


def starts_in_text(first: np.ndarray, n: int) -> np.ndarray:
    """For each window start, whether n words from there lie in one text; first: as of word_spans."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    left = np.repeat(first[1:], np.diff(first))[: total - n + 1] - np.arange(total - n + 1)
    ok &= left >= n
    return ok


def packed_ids(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).to_numpy(zero_copy_only=False)
