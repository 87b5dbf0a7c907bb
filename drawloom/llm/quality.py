"""Quality rules with thresholds learnt per language and source, in DataFrame functions only.

Each measure's distribution is summarised by a mergeable quantile sketch: counts
in logarithmic buckets (relative error under 5 %), added up per (lang, source),
per lang and over all.  The fences come from the sketch quartiles.  A group's
quartiles are drawn towards those of its language, and a language's towards those
of all, by weights that follow from the numbers of documents: every group has
fences of its own, and no size at which they change at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, join_hot, stage, words_of

#: Documents that the wider level counts for: a group of as many is drawn half-way.
DRAWN = 50
#: A fence stands this many quartile distances beyond the quartile.
SPREADS = 4
#: Bucket b of a sketch holds the values v (thousandths) with floor(ln(1 + v) * FINENESS) = b.
FINENESS = 20
#: Measures in thousandths, with the least quartile distance that counts.
MEASURES = {"symbol_rate": 50, "dup_line_rate": 100, "repeat_rate": 100, "upper_rate": 50, "word_length": 500}
#: Measures that may also be too low.
BOTH_SIDES = ("word_length",)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base columns added under names that start with ``_q_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    df = docs.withColumns({"_q_w": words_of(text), "_q_lines": lines})
    n = F.size("_q_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("_q_w", i), F.element_at("_q_w", i + 1), F.element_at("_q_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_q_g", windows)
    # Only texts with a repeated window are sorted; equal windows then stand side by side.
    placed = F.array_sort(F.transform("_q_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_q_s", F.when(F.size(F.array_distinct("_q_g")) < F.size("_q_g"), placed))
    twice = F.filter(
        F.transform("_q_s", lambda x, k: F.when((F.get("_q_s", k + 1)["g"] == x["g"]) | (F.get("_q_s", k - 1)["g"] == x["g"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        *docs.columns,
        F.size("_q_w").cast("long").alias("_q_n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS[:-1]))).cast("long").alias("_q_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_q_n_symbols"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        F.when(F.col("_q_s").isNull(), 0).otherwise(covered).cast("long").alias("_q_n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("_q_n_upper"),
    )


def _rates() -> dict[str, Column]:
    over = lambda a, b: F.floor(F.col(f"_q_{a}") * 1000 / F.greatest(F.col(f"_q_{b}"), F.lit(1))).cast("long")
    return {
        "symbol_rate": over("n_symbols", "n_words"),
        "dup_line_rate": over("n_dup_lines", "n_lines"),
        "repeat_rate": over("n_repeat_words", "n_words"),
        "upper_rate": over("n_upper", "word_chars"),
        "word_length": over("word_chars", "n_words"),
    }


def _base_failed() -> Column:
    return (F.col("_q_n_words") < 50) | (F.col("_q_n_repeat_words") * 100 > F.col("_q_n_words") * 50)


def sketches(measured_docs: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketches of each group, which merge by adding n.

    Texts without words say nothing and are left out.
    """
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.ln(1 + v) * FINENESS).cast("int").alias("bucket")) for m, v in _rates().items()))
    df = measured_docs.where("_q_n_words > 0").select("lang", "source", F.explode(each).alias("x"))
    return df.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """(lang, source, fences): for every group the struct of limits it is held to."""
    levels = {"of_group": ["lang", "source"], "of_lang": ["lang"], "of_all": []}
    groups = sketch.select("lang", "source").distinct()
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        over = Window.partitionBy(*keys, "measure")
        summed = merged.select(*keys, "measure", "bucket", F.sum("n").over(over).alias("total"), F.sum("n").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        low = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket")))
        quart = summed.groupBy(*keys, "measure").agg(F.max("total").alias("total"), low(1).alias("q1"), low(3).alias("q3"))
        value = lambda m, c: F.max(F.when(F.col("measure") == m, F.floor(F.exp(F.col(c) / FINENESS) - 1))).cast("double").alias(f"{m}_{c}")
        made = quart.groupBy(*keys).agg(F.max("total").cast("double").alias("n"), *(value(m, c) for m in MEASURES for c in ("q1", "q3")))
        made = made.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.struct("n", *(f"{m}_{c}" for m in MEASURES for c in ("q1", "q3"))).alias(level))
        if keys:
            on = [groups[k].eqNullSafe(made[f"k_{k}"]) for k in keys]
            groups = groups.join(made, on[0] if len(on) == 1 else on[0] & on[1], "left").drop(*(f"k_{k}" for k in keys))
        else:
            groups = groups.withColumn("k", F.lit(0)).join(F.broadcast(made.withColumn("k", F.lit(0))), "k").drop("k")  # one row
    limits = []
    for m, least in MEASURES.items():
        drawn_to = lambda level, c, wider, m=m: (F.col(f"{level}.n") * F.col(f"{level}.{m}_{c}") + drawn * wider) / (F.col(f"{level}.n") + drawn)
        q1, q3 = (drawn_to("of_group", c, drawn_to("of_lang", c, F.col(f"of_all.{m}_{c}"))) for c in ("q1", "q3"))
        spread = F.greatest(q3 - q1, F.lit(float(least))) * SPREADS
        limits += [(q3 + spread).alias(f"{m}_hi"), (q1 - spread if m in BOTH_SIDES else F.lit(-1.0)).alias(f"{m}_lo")]
    return groups.select("lang", "source", F.struct(*limits).alias("fences"))


def judged(docs: DataFrame, text_col: str = "text", drawn: int = DRAWN) -> DataFrame:
    """``docs`` with ``_q_`` columns: the base measures, ``_q_base_failed`` and ``_q_kept``.

    A null, empty or blank text has no words and fails the base rule.  Null
    languages and sources are groups of their own.  Repeated rows come back
    each; no rows give no rows.
    """
    group = F.to_json(F.struct("lang", "source"))
    df = stage(measured(docs, text_col).withColumn("_q_group", group))
    sketch = stage(sketches(df))
    limits = fences(sketch, drawn).select(group.alias("_q_group"), F.col("fences").alias("_q_fences"))
    rows = df.groupBy("_q_group").agg(F.count(F.lit(1)).alias("_q_rows"))
    limits = stage(rows.join(limits, "_q_group", "left"))
    df = join_hot(df, limits, ["_q_group"], "_q_rows", df.count(), 0)
    inside = F.lit(True)
    for m, v in _rates().items():
        inside = inside & (v <= F.col(f"_q_fences.{m}_hi")) & (v >= F.col(f"_q_fences.{m}_lo"))
    df = df.withColumn("_q_base_failed", _base_failed())
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(inside, F.lit(False))).drop("_q_group", "_q_rows", "_q_fences")


def keep_good(docs: DataFrame, text_col: str = "text", drawn: int = DRAWN) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are.

    Null, empty and blank texts do not pass; repeated rows pass or fail each; no
    rows give no rows.
    """
    return judged(docs, text_col, drawn).where("_q_kept").select(*docs.columns)
