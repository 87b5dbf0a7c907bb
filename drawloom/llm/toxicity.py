"""Toxicity scores from a counterfactual-regularised linear classifier.

The features of a text are its distinct bare words and how many of them begin
with the same four to six characters (once, twice, three times or more), so
that inflected forms count together.  Logistic regression with an L1 penalty is
fitted on a bounded sample of labelled texts, for a falling row of penalties of
which held-back rows choose the best.  Two terms of the loss make it fair: for
every labelled text that names an identity term, the term is swapped with each
other of its group and the squared change of the score is penalised; and so is
the squared score of each term by itself, so that a mention as such tells
nothing even where no labelled text has it.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, distinct_spans, lean, stage, text_chunks, word_bounds

#: Identity terms in groups within which one may stand for another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "american", "mexican", "chinese"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)
MAX_LABELLED = 6000
#: Lengths of the word beginnings that are features, and how often they are told apart.
STEMS = (4, 5, 6)
LEVELS = 3
#: Features are fitted whose shares in toxic and clean texts differ by this many standard errors; at most MAX_FEATURES, the most different.
SCREEN = 4.0
MAX_FEATURES = 600
#: L1 penalties, from strong to weak.
PATH = (3e-3, 1e-3, 3e-4, 1e-4, 3e-5)


def held_out(doc_id):
    """Whether a document's label may not be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def word_features(word: bytes) -> list[bytes]:
    """The word, and its beginnings of fewer characters than it has, marked by a star."""
    text = word.decode("utf-8", "replace")
    return [word, *(text[:k].encode() + b"*" for k in STEMS if len(text) > k)]


def text_features(words) -> list[bytes]:
    """Distinct features of a text's distinct words; a beginning that n words share is there as ``*1`` to ``*n``, up to LEVELS."""
    n = Counter(chain.from_iterable(map(word_features, words)))
    return [f for f, c in n.items() if not f.endswith(b"*")] + [f + b"%d" % k for f, c in n.items() if f.endswith(b"*") for k in range(1, min(c, LEVELS) + 1)]


def _texts(column: pa.Array):
    """(first row, distinct words, place of each word, first word of each row) for runs of whole texts."""
    for first, data, offsets in text_chunks(column):
        low = LOWER[data]
        starts, ends, rows = word_bounds(low, offsets, NOT_ALNUM)
        yield first, *distinct_spans(low, starts, ends), rows


def word_sets(column: pa.Array):
    """(row, features) of each text."""
    for first, words, place, rows in _texts(column):
        for i in range(len(rows) - 1):
            yield first + i, text_features(words[w] for w in np.unique(place[rows[i] : rows[i + 1]]))


class ToxicityModel:
    """Features with their weights, and the intercept."""

    def __init__(self, features: list[bytes], weights, intercept: float):
        self.features, self.weights, self.intercept = features, np.asarray(weights, float), intercept
        self.at = {f: i for i, f in enumerate(features)}
        # a beginning's three levels share a slot, which counts the words that have it
        self.stems = sorted({f[:-1] for f in features if f[-2:-1] == b"*"})
        stem = {f: i for i, f in enumerate(self.stems)}
        self.slot = {f: i for f, i in self.at.items() if f[-2:-1] != b"*"} | {f: len(features) + i for f, i in stem.items()}
        self.level = np.zeros((len(self.stems), LEVELS + 1))
        for f, w in zip(features, self.weights, strict=True):
            if f[-2:-1] == b"*":
                self.level[stem[f[:-1]], int(f[-1:]) :] += w

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.intercept)
        slots, width = self.slot, len(self.features) + len(self.stems)
        for first, words, place, rows in _texts(column):
            found = [[slots[f] for f in word_features(w) if f in slots] for w in words]
            size = np.array([len(x) for x in found], np.int64)
            at = np.flatnonzero(size[place] > 0) if len(words) else np.zeros(0, np.int64)
            if not len(at):
                continue
            row = np.searchsorted(rows, at, "right") - 1
            once = np.unique(row * len(words) + place[at])
            row, word = once // len(words), once % len(words)
            slot = np.concatenate([found[w] for w in word]).astype(np.int64)
            cell, n = np.unique(np.repeat(row, size[word]) * width + slot, return_counts=True)
            row, slot = cell // width, cell % width
            plain = slot < len(self.features)
            np.add.at(out, first + row[plain], self.weights[slot[plain]])
            np.add.at(out, first + row[~plain], self.level[slot[~plain] - len(self.features), np.minimum(n[~plain], LEVELS)])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def screened(sets: list[list[bytes]], labels: np.ndarray, screen: float, most: int) -> list[bytes]:
    """The features whose shares in the two classes differ by ``screen`` standard errors, ``most`` at most."""
    ones, all_ = Counter(chain.from_iterable(s for s, y in zip(sets, labels, strict=True) if y)), Counter(chain.from_iterable(sets))
    names = [f for f, n in all_.items() if n >= 3]
    n, n1 = len(labels), labels.sum()
    a, c = np.array([ones[f] for f in names], float), np.array([all_[f] for f in names], float)
    p = c / n
    z = (a / n1 - (c - a) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    order = sorted(np.flatnonzero(np.abs(z) >= screen), key=lambda i: (-abs(z[i]), names[i]))[:most]
    return sorted(names[i] for i in order)


def _pulls(features: list[bytes], sets, groups) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the fairness penalty: rows of score changes under swaps (per labelled text), and of single terms."""
    at = {f: i for i, f in enumerate(features)}

    def vector(words) -> np.ndarray:
        out = np.zeros(len(features))
        out[[at[f] for f in text_features(words) if f in at]] = 1
        return out

    alone = {t: vector([t.encode()]) for g in groups for t in g}
    swaps = []
    for g in groups:
        for s in sets:
            here = set(s)
            own = [t for t in g if t.encode() in here]
            for a in own:
                swaps += [alone[b] - alone[a] for b in g if b not in own]
    return np.array(swaps).reshape(-1, len(features)), np.array(list(alone.values())).reshape(-1, len(features))


class _Rows:
    """A 0/1 matrix by its cells."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.shape = row, col, shape

    def take(self, keep: np.ndarray) -> _Rows:
        place, cells = np.cumsum(keep) - 1, keep[self.row]
        return _Rows(place[self.row[cells]], self.col[cells], (int(keep.sum()), self.shape[1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, y[self.row], self.shape[1])


def _descend(x: _Rows, y: np.ndarray, pull: np.ndarray, l1: float, w: np.ndarray, b: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient from (w, b) for the logistic loss, the quadratic ``pull`` and the L1 penalty."""
    n, m = x.shape
    active = np.flatnonzero(np.abs(pull).sum(0))
    small = pull[np.ix_(active, active)]
    top = np.linalg.norm(small, 2) if len(active) else 0.0
    v, size = np.ones(m) / np.sqrt(max(m, 1)), 0.0
    for _ in range(30):  # largest curvature of the loss
        v = x.back(x.dot(v))
        size = np.linalg.norm(v)
        v = v / max(size, 1e-12)
    step = 1 / (0.25 * (size / n + 1) + top + 1e-9)
    u, ub, t = w.copy(), b, 1.0
    for _ in range(rounds):
        err = (1 / (1 + np.exp(-np.clip(x.dot(u) + ub, -30, 30))) - y) / n
        grad = x.back(err)
        grad[active] += small @ u[active]
        new = u - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = ub - step * err.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        if np.abs(new - w).max(initial=0) < 1e-5 and abs(nb - b) < 1e-5:
            return new, nb
        w, b, t = new, nb, nt
    return w, b


def fit(sets: list[list[bytes]], labels: np.ndarray, prior: float | None = None, fairness: float = 10.0, groups=IDENTITY_TERMS, path=PATH, screen: float = SCREEN, most: int = MAX_FEATURES, rounds: int = 400) -> ToxicityModel:
    """The model from features (of distinct texts) and labels.

    ``fairness`` weighs the mean squared score change under swaps of identity
    terms and the mean squared score of the terms alone; terms of labelled texts
    have weights whatever the screen says.  ``prior`` is the share of label 1
    where the sample was balanced.  Every fifth row is held back to choose the
    penalty; the last fit is on all rows.  Without labels, or with one label
    only, every score is that share.
    """
    n = len(sets)
    share = float(labels.mean()) if n else 0.0
    prior = share if prior is None else prior
    base = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if n == 0 or share in (0.0, 1.0):
        return ToxicityModel([], [], base)
    terms = {t.encode() for g in groups for t in g}
    seen = terms & set(chain.from_iterable(sets))
    groups_seen = [g for g in groups if any(t.encode() in seen for t in g)]
    features = sorted({*screened(sets, labels, screen, most), *(t.encode() for g in groups_seen for t in g)})
    at = {f: i for i, f in enumerate(features)}
    cells = [[at[f] for f in s if f in at] for s in sets]
    x = _Rows(np.repeat(np.arange(n), [len(c) for c in cells]), np.array([*chain.from_iterable(cells)], np.int64), (n, len(features)))
    swaps, alone = _pulls(features, sets, groups)
    pull = 2 * fairness * (swaps.T @ swaps / n + alone.T @ alone / max(len(alone), 1))
    start = float(np.log(share / (1 - share)))
    held = np.arange(n) % 5 == 4
    y = labels.astype(np.float64)
    w, b, best = np.zeros(len(features)), start, (np.inf, path[0])
    if held.any() and 0 < y[~held].mean() < 1:
        for l1 in path:
            w, b = _descend(x.take(~held), y[~held], pull, l1, w, b, rounds)
            z = np.clip(x.take(held).dot(w) + b, -30, 30)
            loss = float(np.mean(np.log1p(np.exp(z)) - y[held] * z))
            if loss < best[0]:
                best = loss, l1
    w, b = np.zeros(len(features)), start
    for l1 in path[: path.index(best[1]) + 1]:
        w, b = _descend(x, y, pull, l1, w, b, rounds)
    used = np.flatnonzero(w)
    return ToxicityModel([features[i] for i in used], w[used], b + base - start)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled documents, half of each label, in hash order of the ids.

    Only rows whose ``crc32(doc_id as text) mod 5`` is not 0 are learnt from.
    Rows with null ids or labels are left out; a document labelled twice counts
    as toxic if most of its labels are.  Texts with equal features and label
    count once.  Nothing labelled, or one label only, gives a constant score.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("label"))
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = max_labelled // 2
    sample = known.where("label = 1").orderBy(*order).limit(half).unionByName(known.where("label = 0").orderBy(*order).limit(half))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def features(batches):
        for batch in batches:
            sets = [s for _, s in word_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.binary()))], ["doc_id", "label", "features"])

    rows = rows.mapInArrow(lean(features), "doc_id long, label int, features array<binary>").withColumn("features", F.array_sort("features"))
    # texts with equal features and label count once
    rows = rows.withColumn("mark", F.xxhash64("features"))
    first = rows.groupBy("label", "mark").agg(F.min("doc_id").alias("doc_id"))
    rows = stage(rows.join(first, ["label", "mark", "doc_id"], "left_semi").dropDuplicates(["label", "mark"]).select("doc_id", "label", "features"))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.ones / totals.n if totals.n else 0.0
    if len(n) < 2:
        return fit([[]] * n.get(0, 0) + [[]] * n.get(1, 0), np.repeat([0.0, 1.0], [n.get(0, 0), n.get(1, 0)]), prior, **options)
    # only features that the screen lets through, and identity terms, go to the driver
    groups, screen, most = (options.get(k, v) for k, v in (("groups", IDENTITY_TERMS), ("screen", SCREEN), ("most", MAX_FEATURES)))
    counts = rows.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("a")).where("c >= 3")
    share = F.col("c") / (n[0] + n[1])
    z = (F.col("a") / n[1] - (F.col("c") - F.col("a")) / n[0]) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n[1] + 1 / n[0]))
    telling = counts.select("f", F.abs(z).alias("z")).where(F.col("z") >= screen).orderBy(F.col("z").desc(), "f").limit(most).select("f")
    names = docs.sparkSession.createDataFrame([(t.encode(),) for g in groups for t in g], "f binary")
    wanted = telling.unionByName(names).distinct()  # at most ``most`` and the terms
    each = rows.select("doc_id", F.explode("features").alias("f")).join(F.broadcast(wanted), "f").groupBy("doc_id").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    got = sorted((r.doc_id, r.label, tuple(map(bytes, r.fs or ()))) for r in rows.select("doc_id", "label").join(each, "doc_id", "left").collect())
    return fit([list(fs) for _, _, fs in got], np.array([label for _, label, _ in got], float), prior, **options)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for whole texts; null and empty texts get the model's base score, repeated rows come back each."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))

    def run(batches):
        local = ToxicityModel(*shared.value)
        for batch in batches:
            s = local.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(lean(run), f"{id_col} long, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5.

    Null and empty texts get the base score, repeated rows come back each, no
    rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))
    at = docs.columns.index(text_col)

    def run(batches):
        local = ToxicityModel(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(local.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
