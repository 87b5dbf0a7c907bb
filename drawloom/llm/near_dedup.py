"""Near-duplicate documents by HyperMinHash.

A document is its set of k-word shingles.  Each set is sketched into 128
buckets; a bucket's register holds the leading-zero count and ten mantissa bits
of its least hash (two bytes).  Bands of five registers propose candidates.
The registers then estimate the Jaccard similarity, corrected for accidental
register collisions, and only pairs that the estimate cannot rule out are
confirmed on their full shingle sets (of 64-bit hashes of the shingles).

Copies with equal sets are one vertex, so a group of copies costs one row per
document and no pairs.  Within a band bucket the least member is compared with
every other (a star), which links most groups.  Only buckets that then still
hold several components are compared block by block, and only pairs of
different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_spans, join_hot, join_spread, lean, mix, shingle_hashes, stage, text_chunks, word_bounds
from .components import connected_components

BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND_ROWS = 5
EMPTY = 0xFFFF
#: Shingles and members of one bucket compared in one task; larger buckets are split into pairs of blocks.
BLOCK = 1 << 20
MEMBERS = 4096
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 6.0


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct 64-bit hashes."""
    out = np.full(1 << BUCKET_BITS, EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[lead] << np.uint64(BUCKET_BITS)) | np.uint64(1 << BUCKET_BITS - 1)
    exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 62).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[lead]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands of register rows; an empty bucket borrows the next filled one."""
    n, width = regs.shape
    at = np.where(regs != EMPTY, np.arange(width), width)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    following = np.where(following == width, following[:, :1], following)
    dense = np.take_along_axis(regs, following, 1).astype(np.uint64)
    bands = width // BAND_ROWS
    rows = dense[:, : bands * BAND_ROWS].reshape(n, bands, BAND_ROWS)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
    for j in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows and the number of buckets it rests on.

    The expected number of accidental matches follows the published
    approximation for sets of na and nb elements.
    """
    filled = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    equal = ((a == b) & (a != EMPTY)).sum(-1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / np.maximum(filled, 1), filled


def may_reach(a, b, na, nb, threshold: float) -> np.ndarray:
    """Whether the estimate cannot rule out a similarity of ``threshold``.

    The filled buckets are a sample without replacement of the union, so the
    deviation shrinks as they come to cover it (short documents).
    """
    estimate, filled = estimated_jaccard(a, b, na, nb)
    filled = np.maximum(filled, 1)
    union = np.maximum((na + nb) / (1 + threshold), 2)
    unseen = np.clip((union - filled) / (union - 1), 0, 1)
    return estimate >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / filled * unseen) - 1 / filled - 1e-9


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for first, data, offsets in text_chunks(batch.column(1)):
        low = LOWER[data]
        starts, ends, row_first = word_bounds(low, offsets)
        shingles, begin = shingle_hashes(hash_spans(low, starts, ends), row_first, k)
        for i in range(len(begin) - 1):
            x = np.sort(shingles[begin[i] : begin[i + 1]])
            yield first + i, x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sketch(k: int, least: int):
    def run(batches):
        for batch in batches:
            n, one, two, regs = [], [], [], []
            for _, x in _sets(batch, k):
                n.append(len(x))
                one.append(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0)
                two.append(int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0)
                regs.append(registers(x).tobytes() if len(x) >= least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "fp1", "fp2", "regs"])

    return run


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bands(batches):
    """(id, n, band) for every band of the rows (id, n, regs)."""
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_register_rows(batch.column(2)))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys.ravel())], ["id", "n", "band"])


def _full(k: int):
    """(id, n, regs, bands, shingles) of the texts, in batches of bounded size.

    Of rows with the same id that follow each other (as they do after a merge
    join) those with the same set count once.
    """

    def run(batches):
        last, seen = None, set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held, at, regs, bands, sets = 0, [], [], [], []
            for row, x in _sets(batch, k):
                if ids[row] != last:
                    last, seen = ids[row], set()
                mark = len(x), int(mix(x).sum(dtype=np.uint64))
                if mark in seen:
                    continue
                seen.add(mark)
                reg = registers(x)
                at.append(ids[row])
                regs.append(reg.tobytes())
                bands.append(band_keys(reg[None])[0])
                sets.append(x.view(np.int64))
                held += len(x)
                if held > 1 << 21:
                    yield _full_batch(at, regs, bands, sets)
                    held, at, regs, bands, sets = 0, [], [], [], []
            yield _full_batch(at, regs, bands, sets)

    return run


def _full_batch(ids, regs, bands, sets):
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, longs), pa.array(sets, longs)], ["id", "n", "regs", "bands", "shingles"])


def _rule_out(threshold: float):
    """Keep the rows (a, b, ...) whose registers may reach the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (_register_rows(batch.column(c)) for c in ("ra", "rb"))
            ok = may_reach(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def _block_partners(up: int, down: int):
    """Members of a band bucket (or of two blocks of it) that the registers allow a partner of another component there."""

    def run(t: pa.Table) -> pa.Table:
        side, comp, ids, n = (t.column(c).to_numpy() for c in ("side", "comp", "id", "n"))
        regs = _register_rows(t.column("regs"))
        right = np.flatnonzero(side == (1 if side.any() else 0))
        right = right[np.argsort(n[right], kind="stable")]
        sizes = n[right]
        found = np.zeros(len(ids), bool)
        for i in np.flatnonzero(side == 0):
            js = right[np.searchsorted(sizes * down, n[i] * up) : np.searchsorted(sizes * up, n[i] * down, "right")]
            js = js[comp[js] != comp[i]]
            if found[i]:
                js = js[~found[js]]
            js = js[may_reach(regs[i], regs[js], n[i], n[js], up / down)]
            found[js] = True
            found[i] |= len(js) > 0
        return pa.table({"id": pa.array(ids[found], pa.int64())})

    return run


def _block_links(up: int, down: int):
    """Links between components within a band bucket, or between two blocks of it.

    A pair is looked at in its first common band only, ruled out by its
    registers where they can, and else confirmed on the full sets.
    """

    def run(t: pa.Table) -> pa.Table:
        side, comp, ids, n, band = (t.column(c).to_numpy() for c in ("side", "comp", "id", "n", "band"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        sets = t.column("shingles").combine_chunks()
        values = sets.flatten().to_numpy().view(np.uint64)
        begin = np.concatenate([[0], np.cumsum(n)])
        place = int(np.flatnonzero(bands[0] == band[0])[0])
        one_block = not side.any()
        pairs = []
        for i in np.flatnonzero(side == 0):
            js = np.flatnonzero((comp != comp[i]) & (side == (0 if one_block else 1)) & (np.minimum(n, n[i]) * down >= np.maximum(n, n[i]) * up))
            js = js[js > i] if one_block else js
            js = js[~(bands[js, :place] == bands[i, :place]).any(1)]
            js = js[may_reach(regs[i], regs[js], n[i], n[js], up / down)]
            if len(js):
                own = values[begin[i] : begin[i + 1]]
                other = np.concatenate([values[begin[j] : begin[j + 1]] for j in js])
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[js])[:-1]]))
                js = js[common * down >= (n[i] + n[js] - common) * up]
                pairs += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _named(src: DataFrame) -> tuple[DataFrame, int | None]:
    """``src`` with numbers of their own, beyond all ids, for rows without an id, and the first such number."""
    facts = src.agg(F.count_if(F.col("id").isNull()).alias("nulls"), F.max("id").alias("top")).first()
    if not facts.nulls:
        return src, None
    first = max(-1, facts.top if facts.top is not None else -1) + 1
    if first >= 2**62:
        raise ValueError("ids from 2^62 on leave no numbers for rows without an id")
    rows = stage(src.where("id is null").select((F.lit(first) + F.monotonically_increasing_id()).alias("id"), "text"))
    return src.where("id is not null").unionByName(rows), first


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked when ``threshold[1] * |A & B| >= threshold[0] * |A | B|``
    over their sets of distinct ``words``-word shingles (A-Z lower-cased; with
    fewer words, the whole sequence is the one shingle).  component_id is the
    least id reachable over links, ``kept`` marks the document that has it.

    Null, empty and blank texts have empty sets (n_shingles 0), link to nothing
    and are kept.  Rows with the same id count as one document, so what either
    links to is one component; they come back once each.  Every row with a null id
    is a document of its own: it is linked like any other, stands behind all ids,
    and where a component has no id at all its component_id is null and one of
    its rows is kept.  No rows give no rows.  Other columns are ignored.
    """
    up, down = threshold
    ratio = up / down
    least = next(n for n in range(1, 10**6) if down * n >= up * (n + 1))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src, unnamed = _named(src)
    sketch = stage(src.mapInArrow(lean(_sketch(words, least)), "id long, n long, fp1 long, fp2 long, regs binary"))

    key = ["fp1", "fp2", "n"]
    classes = stage(sketch.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    firsts = stage(sketch.where("regs is not null").join(classes.withColumn("id", F.col("rep")), [*key, "id"], "left_semi").select("id", "n", "regs").distinct())
    members = firsts.mapInArrow(lean(_bands), "id long, n long, band long")
    buckets = stage(members.groupBy("band").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    in_buckets = (1 << BUCKET_BITS) // BAND_ROWS * firsts.count()
    members = stage(join_hot(members, buckets, ["band"], "m", in_buckets))

    # Stars: the least member of a bucket with every other.
    pairs = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    own = lambda i: firsts.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("regs").alias(f"r{i}"))
    pairs = stage(pairs)
    sized = join_spread(pairs, own("a"), "a", "b", pairs.count()).join(own("b"), "b").where(F.least("na", "nb") * down >= F.greatest("na", "nb") * up)
    likely = stage(sized.mapInArrow(_rule_out(ratio), "a long, b long"))
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    sets = lambda ids: stage(src.join(ids, "id", "left_semi").mapInArrow(lean(_full(words)), "id long, n long, regs binary, bands array<long>, shingles array<long>"))
    full = sets(wanted.hint("merge"))
    side = lambda i: full.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("shingles").alias(f"s{i}"))
    both = join_spread(likely, side("a"), "a", "b", likely.count()).join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = stage(both.where(common * down >= (F.col("na") + F.col("nb") - common) * up).select("a", "b"))
    labels = connected_components(links)

    # Buckets that still hold several components: who may have a partner of another one there?
    placed = stage(members.where("m > 2 and id <> center").join(labels, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("comp")))
    apart = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles_in")).where("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("shingles_in") / BLOCK, F.col("m") / MEMBERS)).cast("int")
    apart = stage(apart.select("band", "m", blocks.alias("blocks")))
    mixed = join_hot(placed, apart, ["band"], "m", in_buckets).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "id", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    spread = stage(spread)
    partners = stage(spread.join(firsts, "id").groupBy("band", "i", "j").applyInArrow(_block_partners(up, down), "id long").distinct())
    if not partners.isEmpty():
        full = full.join(partners, "id", "left_semi").unionByName(sets(partners.join(wanted, "id", "left_anti")))
        open_ = spread.join(full, "id")
        more = stage(open_.groupBy("band", "i", "j").applyInArrow(_block_links(up, down), "a long, b long"))
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    roots = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*key, "copies", F.coalesce("component", "rep").alias("component"))
    found = stage(join_hot(sketch.select("id", *key).where("n > 0"), stage(roots), key, "copies", sketch.count()).select("id", "n", "component"))
    # Rows with the same id are one document: their components are one.
    several = found.groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    ties = stage(found.join(several, "id").select(F.col("component").alias("a"), F.col("lo").alias("b")).where("a <> b"))
    if not ties.isEmpty():
        joined = connected_components(ties).select(F.col("id").alias("component"), F.col("component").alias("least"))
        found = found.join(joined, "component", "left").select("id", "n", F.coalesce("least", "component").alias("component"))
    out = found.unionByName(sketch.where("n = 0").select("id", "n", F.col("id").alias("component")))
    shown = lambda c: F.col(c) if unnamed is None else F.when(F.col(c) < unnamed, F.col(c))
    return out.select(shown("id").alias(id_col), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
