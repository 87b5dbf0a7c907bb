"""Readers and writers of draw history, market tables, ledgers and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import issue_key, parse_draw_date, to_int_money
from ..operators.completeness import number_errors
from ..operators.merge import latest_upsert

#: Header names of history files and what they hold.
HEADERS = {"期号": "issue", "开奖日期": "draw_date", "总投注额(元)": "sales", "销售额": "sales", "奖池奖金(元)": "pool", "奖池": "pool", "一等奖注数": "winners1", "一等奖奖金（元）": "prize1", "二等奖注数": "winners2", "二等奖奖金（元）": "prize2"}
#: Number columns of both shapes, with the array that they make.
NUMBERS = {"红球": "front", "蓝球": "back", "号码": "front"}


def read_draw_csv(spark: SparkSession, path: str, game: str, encoding: str = "UTF-8", headers: dict[str, str] | None = None) -> DataFrame:
    """Draw history in either column shape (``红球i`` and ``蓝球i``, or ``号码i``) as typed rows of ``game``.

    Header names go by ``headers`` (HEADERS); a byte-order mark, and blanks
    around names, are taken off.  ``#`` and blanks are missing; issue_year and
    issue_seq are null where the issue number is none.  Encodings such as GBK are
    read by way of the session's ``spark.sql.legacy.javaCharsets``, which is set.
    """
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1") and not encoding.upper().startswith(("UTF-16", "UTF-32")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    known = {c: (headers or HEADERS)[c] for c in raw.columns if c in (headers or HEADERS)}
    arrays: dict[str, list[tuple[int, str]]] = {}
    for c in raw.columns:
        m = re.fullmatch(r"(\D+?)(\d+)", c)
        if m and m[1] in NUMBERS:
            arrays.setdefault(NUMBERS[m[1]], []).append((int(m[2]), c))
    number = lambda c: F.trim(F.col(f"`{c}`")).try_cast("int")
    df = raw.select(F.lit(game).alias("lottery"), *(F.col(f"`{c}`").alias(n) for c, n in known.items()), *(F.array(*(number(c) for _, c in sorted(cs))).alias(n) for n, cs in arrays.items()))
    key = issue_key(F.col("issue"))
    out = df.withColumn("issue_year", key["year"]).withColumn("issue_seq", key["seq"])
    for name in known.values():
        if name == "draw_date":
            out = out.withColumn(name, parse_draw_date(F.col(name)))
        elif name != "issue":
            out = out.withColumn(name, to_int_money(F.when(~F.col(name).startswith("#"), F.col(name))))
    return out


def read_ledger_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a file with a JSON object a line."""
    df = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # the line itself too, as the mark alone cannot be read from a file
    lines = spark.read.text(path).select(F.col("value").alias("_bad"))
    fields = spark.createDataFrame([], schema).schema
    parsed = lines.withColumn("_row", F.from_json("_bad", fields, {"mode": "PERMISSIVE"})).where(F.trim("_bad") != "")
    return df.where("_bad is null").drop("_bad"), parsed.where(F.to_json("_row") == "{}").select("_bad")


def write_ledger_jsonl(df: DataFrame, path: str, leading: list[str]) -> None:
    """One JSON object a line: the ``leading`` fields first, in order, then the others; nulls are written."""
    rest = [c for c in df.columns if c not in leading]
    df.select(*leading, *rest).write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: Primary keys of the market tables.
KEYS = {
    "lottery": ["lottery"], "draw": ["lottery", "issue", "source"], "prize": ["lottery", "issue", "source", "level"], "prize_region": ["lottery", "issue", "source", "region"],
    "region_probe": ["lottery", "issue"], "region_sales": ["ym", "region", "agency"],
}


def write_market(df: DataFrame, path: str, table: str, order: str | None = None) -> None:
    """Upsert into a market table: of each primary key the row with the highest ``order``, new rows before old ones.

    Tables with games are laid out by game, and only the games that ``df`` holds
    are written.  The merged rows are written beside the table before they take
    the place of the old ones, as a table cannot be read and overwritten at once.
    """
    spark, key = df.sparkSession, KEYS[table]
    target = f"{path}/{table}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(hadoop)
    new = df if order else df.withColumn("_order", F.lit(0))
    if fs.exists(jvm.org.apache.hadoop.fs.Path(target)):
        old = spark.read.parquet(target)
        if "lottery" in key:
            old = old.join(df.select("lottery").distinct(), "lottery", "left_semi")
        old = old.select(*df.columns)
        merged = latest_upsert(old if order else old.withColumn("_order", F.lit(0)), new, key, order or "_order")
    else:
        merged = latest_upsert(new.limit(0), new, key, order or "_order")
    merged.drop("_order").write.mode("overwrite").parquet(f"{target}_new")
    out = spark.read.parquet(f"{target}_new").write.mode("overwrite")
    (out.option("partitionOverwriteMode", "dynamic").partitionBy("lottery") if "lottery" in key else out).parquet(target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}_new"), True)


def read_market(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def explode_pending(df: DataFrame, ticket: str | None = None) -> DataFrame:
    """One row per ticket of a pending batch, with its place ``seq`` from 1 and the batch size.

    ``tickets`` is an array, or JSON text of one whose elements have the schema
    ``ticket``; a batch without tickets gives no row.
    """
    if ticket:
        df = df.withColumn("tickets", F.from_json("tickets", f"array<struct<{ticket}>>"))
    rest = [c for c in df.columns if c != "tickets"]
    return df.select(*rest, F.size("tickets").alias("batch_size"), F.posexplode("tickets").alias("pos", "ticket")).select(*rest, "batch_size", (F.col("pos") + 1).alias("seq"), "ticket")


def export_csv(draws: DataFrame, path: str, size: int, high: int, bonus_size: int, bonus_high: int) -> DataFrame:
    """Write the valid draws in issue order as CSV with a column a number; return those left out, with ``errors``.

    A draw is left out if a zone's numbers are wrong in count, range or by
    repetition, or if a bonus number is one of its main numbers.
    """
    shared = F.when(F.arrays_overlap("front", "back"), F.array(F.lit("shared"))).otherwise(F.array().cast("array<string>"))
    d = draws.withColumn("errors", F.concat(number_errors(F.col("front"), size, 1, high), number_errors(F.col("back"), bonus_size, 1, bonus_high), shared))
    good = d.where(F.size("errors") == 0)
    columns = [F.get("front", F.lit(i)).alias(f"n{i + 1}") for i in range(size)] + [F.get("back", F.lit(i)).alias(f"b{i + 1}") for i in range(bonus_size)]
    good.select("lottery", "issue_year", "issue_seq", "draw_date", *columns, "sales").orderBy("lottery", "issue_year", "issue_seq").write.mode("overwrite").option("header", True).csv(path)
    return d.where(F.size("errors") > 0)
