"""Best-fit packing of tokenised documents into sequences by linear grouping.

The plan is made from the histogram of piece lengths alone, which has at most
``capacity`` entries whatever the corpus size.  Large lengths are put into
groups of equal cardinality and rounded up to their group's largest; the few
rounded sizes are combined into configurations (fullest first, each holding the
largest size left, found by a bitset subset-sum); real lengths then take the
slots in rank order, and small lengths are best-fitted into what is left.

Each row of the plan says: pieces of this length with ranks r..r+n-1 go to the
sequences q..q+n-1, at this offset.  Executors rank the pieces of a length
(salted, so that a hot length is split) and look their place up.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage

CAPACITY = 2048
GROUPS = 256
#: Lengths above this share of the capacity are large.
LARGE = 8
#: Pieces of one length that are ranked in one task, about.
RANKED = 1 << 18
#: Cached chunks and parts, each, in a Python worker.
CACHE = 100_000


# --------------------------------------------------------------------------
# Token ids
# --------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others move above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class _Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, by way of white-space-free chunks.

    The tokenizer drops white space before it looks at anything else, so a
    text's ids are those of its chunks in a row; chunks repeat and are cached.
    A plain chunk (Latin letters in composed form) is split here and its parts
    go to the tokenizer's own model; any other goes through all of it.
    """

    #: The pre-token pattern that the vocabulary file states, for the plain letters below.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    #: Printable ASCII and composed Latin letters that have a one-character lower case.
    PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įĴ-ňŊ-ž]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = _byte_letters()
        outer = self

        class Cache(dict):
            """Two generations: what is used again while the newer one fills is kept."""

            def __init__(self, work):
                super().__init__()
                self.work, self.old = work, {}

            def __missing__(self, key):
                out = self.old.get(key)
                if out is None:
                    out = self.work(key)
                if len(self) >= CACHE:
                    self.old = dict(self)
                    self.clear()
                self[key] = out
                return out

        self.parts = Cache(outer.part)
        self.chunks = Cache(outer.chunk)

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self.parts[chunk.lower().decode()]
        text = chunk.decode("utf-8", "replace")
        if "<|" in text or not self.PLAIN.fullmatch(text):
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.parts[p] for p in self.PARTS.findall(text.lower())])

    def part(self, part: str) -> bytes:
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: bytes) -> bytes:
        # bytes.split() cuts at exactly the six ASCII white-space bytes
        return b"".join(map(self.chunks.__getitem__, text.split()))


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One encoder, with its caches, for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids end with id 0; only documents of more than ``capacity``
    ids are cut.  Null and empty texts are the single id 0.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for lo in range(0, batch.num_rows, 256):
                out = [[] for _ in range(6)]
                for doc, text in zip(batch.column(0)[lo : lo + 256].to_pylist(), texts[lo : lo + 256].to_pylist(), strict=True):
                    ids = enc.encode(text or b"") + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None), strict=True):
                            col.append(v)
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(run), schema)


# --------------------------------------------------------------------------
# The plan
# --------------------------------------------------------------------------


def _configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The fullest configuration with the largest size left: {index: how many}."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for i in range(first, len(sizes)):
        if sizes[i] > room:
            continue
        for _ in range(min(left[i] - (i == first), room // sizes[i])):
            grown = reach | reach << sizes[i] & mask
            if grown == reach:
                break
            steps.append((i, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {first: 1}
    for i, before in reversed(steps):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + 1
            at -= sizes[i]
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, how many, first sequence, offset) that place every piece."""
    rows: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n * LARGE > capacity and histogram[n] > 0]
    each = -(-sum(c for _, c in large) // groups) or 1
    sizes, left, runs = [], [], []  # a group's runs: [length, next rank, how many]
    for length, count in large:
        rank = 0
        while count:
            if not left or left[-1] == each:
                sizes.append(length)
                left.append(0)
                runs.append([])
            k = min(count, each - left[-1])
            runs[-1].append([length, rank, k])
            left[-1] += k
            rank += k
            count -= k
    while any(left):
        used = _configuration(sizes, left, capacity)
        times = min(left[i] // n for i, n in used.items())
        slots = [i for i, n in used.items() for _ in range(n)]
        for i, n in used.items():
            left[i] -= n * times
        # every slot takes the next ``times`` pieces of its group
        taken = []
        for i in slots:
            need, own = times, []
            while need:
                run = runs[i][0]
                k = min(need, run[2])
                own.append((run[0], run[1], k))
                run[1] += k
                run[2] -= k
                need -= k
                if not run[2]:
                    runs[i].pop(0)
            taken.append(own)
        cuts = sorted({0, *(int(x) for own in taken for x in np.cumsum([k for *_, k in own]))})
        at = [[own, 0, 0] for own in taken]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for state in at:
                own, j, gone = state
                length, rank, k = own[j]
                rows.append((length, rank + gone, hi - lo, sequences + lo, offset))
                offset += length
                state[2] += hi - lo
                if state[2] == k:
                    state[1:] = [j + 1, 0]
            bins.setdefault(capacity - offset, []).append((sequences + lo, hi - lo))
        sequences += times

    for length in sorted((n for n in histogram if n * LARGE <= capacity), reverse=True):
        count, rank = histogram[length], 0
        while count:
            fit = min((s for s, b in bins.items() if s >= length and b), default=None)
            if fit is None:
                per = capacity // length
                n = max(1, count // per)
                bins.setdefault(capacity, []).append((sequences, n))
                sequences += n
                continue
            first, n = bins[fit].pop()
            k = min(n, count)
            if k < n:
                bins[fit].append((first + k, n - k))
            rows.append((length, rank, k, first, capacity - fit))
            bins.setdefault(fit - length, []).append((first, k))
            rank += k
            count -= k
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Pieces fill sequences without gaps from offset 0.  Repeated rows are packed
    as often as they come; no rows give no rows.  Only the histogram of
    lengths, at most ``capacity`` rows, goes to the driver.
    """
    spark = cut.sparkSession
    cut = stage(cut)
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan(histogram, capacity, groups)), np.int64).reshape(-1, 5)
    keys = spark.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))

    # one row a length; and at most 8 a length and 8 for every RANKED pieces
    salts = spark.createDataFrame([(length, 8 * (1 + n // RANKED)) for length, n in histogram.items()], "length long, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts").cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long") - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "salt"])
    columns = cut.columns
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        key, table = keys.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            found = [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4].copy())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + found, [*columns, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise documents, cut the long ones and pack all pieces.

    Null or empty texts are one piece of the single id 0; every row of ``docs``
    is packed, repeated ones too; null ids stay null.
    """
    return pack(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), capacity)
