"""Near-duplicates without ids and around hubs, limits of small groups, and joins on hot keys."""

import random

from pyspark.sql import functions as F
from test_operators import _components, _docs

from drawloom.llm import common, near_dedup, quality


def test_rows_without_an_id_are_documents(spark):
    same, other, alone = ("alpha beta gamma delta " * 9, "one two three four five six " * 9, "x y z w v u t " * 9)
    rows = [(None, same, "s"), (7, same, "s"), (5, same, "s"), (None, other, "s"), (None, other + "seven", "s"), (None, alone, "s"), (None, None, "s"), (None, "", "s"), (3, "b " * 60, "s")]
    got = near_dedup.near_duplicates(_docs(spark, rows), 3, (60, 100)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, 3, True), (5, 5, True), (7, 5, False)]
    unnamed = sorted((r.n_shingles, r.component_id is None, r.kept) for r in got if r.doc_id is None)
    sizes = {t: len({tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}) for t in (same, other, other + "seven", alone)}
    assert sum(k for _, null, k in unnamed if null) == 4  # the pair of others, the lone one, two without words
    assert [(sizes[same], False, False)] == [u for u in unnamed if not u[1]]
    assert sorted(n for n, _, _ in unnamed) == sorted([0, 0, *sizes.values()])


def test_many_links_at_one_centre(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(900):
        words = list(base)
        words[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(words), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(_docs(spark, rows), 3, (85, 100)).collect()}
    assert got == _components(rows, 3, 85, 100)


def test_join_spread_equals_a_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    spread = common.join_spread(big, small, "k", "v", 5000, least=100)
    assert sorted(map(tuple, spread.select("k", "v", "w").collect())) == sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))


def _fences(spark, counts):
    """Limits of groups whose symbol rate is that of their source."""
    rows = []
    for (lang, source, rate), n in counts.items():
        rows += [(len(rows) + i, ("word " * (100 - rate)) + "# " * rate, lang, source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {(r.lang, r.source): r.fences for r in quality.fences(quality.sketches(quality.measured(docs))).collect()}


def test_small_groups_have_limits_of_their_own_that_move_smoothly(spark):
    made = _fences(spark, {("en", "a", 0): 60, ("en", "b", 20): 5, ("de", "a", 10): 30})
    his = [f.symbol_rate_hi for f in made.values()]
    assert len(set(his)) == 3 and made[("en", "a")].symbol_rate_hi < made[("en", "b")].symbol_rate_hi
    before = None
    for n in (1, 10, 40, 160):
        hi = _fences(spark, {("en", "a", 0): 300, ("en", "b", 20): n})[("en", "b")].symbol_rate_hi
        assert before is None or before < hi
        before = hi
    assert before > 300
