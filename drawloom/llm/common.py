"""Shared helpers: tables, staging folder, whole-batch word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Words are runs of anything but these white-space bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Seed of the word hash.
SEED = 0x5DEECE66D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop), a temporary folder is
    set; a cluster's session must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="drawloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_STAGED: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/drawloom-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """How many folders this process has staged and not cleared."""
    return len(_STAGED)


def clear_stages(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the folders staged after the first ``since``, but for the last ``keep``, and say how many.

    For when the results have been written: DataFrames returned before still
    read the staged folders.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = _STAGED[since : len(_STAGED) - keep]
    del _STAGED[since : len(_STAGED) - keep]
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)
    return len(gone)


#: Keys that may count as hot: what is broadcast for them has at most this many rows.
MAX_HOT = 20_000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int, least: int = 500) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, ``rows`` saying how often ``big`` has it).

    Keys with more than ``total / MAX_HOT`` of the ``total`` rows, and at least
    ``least``, are fewer than MAX_HOT: they are broadcast, so no task gets all
    rows of one.  The rest is joined by a shuffle.  ``big`` is read twice.
    """
    bound = max(least, total // MAX_HOT)
    hot, cold = small.where(F.col(rows) > bound), small.where(F.col(rows) <= bound)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return big.join(F.broadcast(hot), keys).select(*rest.columns).unionByName(rest)


def join_spread(big: DataFrame, small: DataFrame, key: str, by: str, total: int, least: int = 500) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, of any size) on ``key``.

    Rows of ``big`` whose key has more than ``total / MAX_HOT`` of its ``total``
    rows, and at least ``least``, are dealt by ``by`` into parts of about so
    many; the row of ``small`` is repeated for each part.  Only the hot keys and
    their numbers of parts, fewer than MAX_HOT, are broadcast.  ``big`` is read
    twice.
    """
    bound = max(least, total // MAX_HOT)
    parts = big.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("_parts"))
    parts = F.broadcast(stage(parts))
    salted = big.join(parts, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    each = small.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(each.hint("merge"), [key, "_salt"]).drop("_salt")


def hash_sample(df: DataFrame, id_col: str, n: int, keep: Column, shape=lambda rows: rows) -> DataFrame:
    """``keep`` (as column ``kept``) where it is not null, of the ``n`` rows that come first in hash order of their ids.

    A bound on the hash, from the number of rows, lets about four times ``n``
    rows through before they are ordered, so what reaches the driver does not
    grow with the number of partitions; ``shape`` may make ``kept`` of those
    rows (hash, id, kept) smaller first.  Where over three quarters of ``keep``
    are null the sample may be smaller; no rows give no rows.
    """
    share = min(1.0, 4 * n / max(df.count(), 1))
    bound = min(int(share * 2**64) - 2**63, 2**63 - 1)
    hashed = F.xxhash64(id_col)
    few = df.where((hashed <= F.lit(bound)) & keep.isNotNull()).select(hashed.alias("hash"), F.col(id_col).alias("id"), keep.alias("kept"))
    return shape(few).orderBy("hash", "id").limit(n).select("kept")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def lean(run):
    """``run`` (batches to batches), after which the Python worker gives what it has freed back to the system.

    Workers are used again by later tasks of other kinds; what one kind freed
    and another cannot use would otherwise add up in an executor.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# ---------------------------------------------------------------------------
# Word hashing over whole Arrow batches: a batch's distinct words are found by
# Arrow on their bytes, and each is hashed once.
# ---------------------------------------------------------------------------

_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACES = _space_table()
LOWER = _lower_table()
#: Everything ASCII but letters and digits: the separators of bare words.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def text_chunks(column: pa.Array):
    """Yield (first row, byte array, row offsets) for runs of whole texts of about 1 MB; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
    """Starts and ends of words, and the index of the first word of each row (with the total last)."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among data[start:end], and the place of each span among them.

    Spans are in order and do not overlap; none is empty.
    """
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    body = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 of data[start:end] for each span."""
    words, place = distinct_spans(data, starts, ends)
    return np.array([xxh3_64_intdigest(w, SEED) for w in words], np.uint64)[place]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and each row's first window.

    A row of fewer than k words but at least one gives its whole sequence as one.
    """
    counts = np.diff(first)
    n = len(words)
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if len(total) else 0):
        total += words[j : n - k + 1 + j] * salt[j]
    total = mix(total)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint64)
    row = np.repeat(np.arange(len(counts)), sizes)
    at = first[row] + (np.arange(begin[-1]) - begin[row])
    long = counts[row] >= k
    out[long] = total[at[long]]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        m = counts[r]
        out[begin[r]] = mix(np.atleast_1d((words[first[r] : first[r + 1]] * salt[:m]).sum(dtype=np.uint64) + np.uint64(m)))[0]
    return out, begin


# ---------------------------------------------------------------------------
# Vectors of integers.
# ---------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; an empty one is usable."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def integers(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * v) + offset of every component as long; raises an error where that may not fit."""

    def whole(v: Column) -> Column:
        large = v.cast("double") * scale
        return F.when(F.abs(large) < float(2**62), F.floor(large) + offset).otherwise(F.raise_error(F.lit("a component is too large for an integer of 64 bits")).cast("long"))

    return F.transform(vector, whole)


def dense(lists: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Lists of integers as a matrix; missing trailing entries are ``fill``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), width), fill, np.int64)
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out
