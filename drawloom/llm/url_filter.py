"""URL filter: rules first, then trust and distrust carried over the host graph.

DataFrame functions only.  Hosts of allowed pages seed trust, hosts of blocked
pages seed distrust.  Edges are the hyperlinks between hosts and the steps
between a host and its parent domain.  Personalised PageRank carries trust
along the edges and distrust against them; a host whose distrust outweighs its
trust is blocked.  The rounds go on until what is still to come cannot turn the
verdict of any host that has pages without a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage

#: (host and its subdomains, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DAMPING = 0.85
#: Rounds between two looks at what is still open, and the mass still to come that counts as none.
ROUNDS = 10
TOLERANCE = 1e-12
#: A host is blocked if its distrust exceeds this many times its trust.
THRESHOLD = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule (host plus path; of equals the first) as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):  # the last one put around decides
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: how often pages of src link to dst, and parent steps both ways."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^\s"'<>/?#]+)"""), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), target.alias("to")).select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> ''")
    links = stage(links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).unionByName(pages.select("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = hosts.where(F.size(labels) > 1).select(suffix.alias("chain"))
    step = chain.select(F.explode(F.filter(F.transform("chain", lambda h, i: F.struct(h.alias("child"), F.get("chain", i + 1).alias("parent"))), lambda s: s["parent"].isNotNull())).alias("s")).select("s.*").distinct()
    steps = step.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight")).unionByName(step.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("weight")))
    return links.where("src <> dst").unionByName(steps).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust) for pages with host and verdict columns.

    Seeds weigh as the share of all allowed (or blocked) pages that the host has.
    The scores are partial sums that only grow.  After n rounds at most
    DAMPING ** (n + 1) of either mass is still to come, and none for a host
    without any once no round reaches new hosts.  The rounds end when that leaves
    no host with pages without a rule undecided, or when it falls under TOLERANCE
    and no new host is reached: only scores that close count as they stand.
    """
    seeds = pages.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"), F.max(F.col("verdict").isNull()).alias("open"))
    total = seeds.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    seeds = stage(seeds.withColumn("k", F.lit(0)).join(F.broadcast(total.withColumn("k", F.lit(0))), "k").select("host", "open", F.coalesce(F.try_divide("a", "ta"), F.lit(0.0)).alias("st"), F.coalesce(F.try_divide("b", "tb"), F.lit(0.0)).alias("sd")))
    edges = stage(host_edges(pages))
    out_of = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("total"))
    into = edges.groupBy(F.col("dst").alias("s")).agg(F.sum("weight").alias("total"))
    forward = edges.join(out_of, F.expr("src = s")).select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"))
    reverse = edges.join(into, F.expr("dst = s")).select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("weight") / F.col("total")).alias("wd"))
    moves = stage(forward.unionByName(reverse).groupBy("from", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")))
    start = stage(seeds.select("host", (F.col("st") * (1 - DAMPING)).alias("t"), (F.col("sd") * (1 - DAMPING)).alias("d"), "open"))
    rank, done, reached = start, 0, None
    while True:
        for _ in range(ROUNDS):
            sent = moves.join(rank, F.expr("`from` = host")).select(F.col("to").alias("host"), (F.col("t") * F.col("wt") * DAMPING).alias("t"), (F.col("d") * F.col("wd") * DAMPING).alias("d"), F.lit(False).alias("open"))
            rank = sent.unionByName(start).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), F.max("open").alias("open"))
        rank, done = stage(rank), done + ROUNDS
        rest, before = DAMPING ** (done + 1), reached
        reached = rank.agg(F.count(F.when(F.col("t") > 0, 1)), F.count(F.when(F.col("d") > 0, 1))).first()
        if reached != before:
            continue
        most = lambda c: F.when(F.col(c) > 0, F.col(c) + rest).otherwise(0.0)
        decided = (F.col("d") > threshold * most("t")) | (most("d") <= threshold * F.col("t"))
        if rest < TOLERANCE or rank.where(F.col("open") & ~decided).isEmpty():
            return rank.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A fitting rule decides; else the host's scores do (distrust over
    ``threshold`` times trust blocks, a host without scores is allowed).  Null
    urls and urls without ``://`` have empty host and path and are allowed.
    Null html has no links.  Repeated rows come back each; no rows give no rows.
    """
    url = F.col(url_col)
    df = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    df = df.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", F.col("found.verdict"))
    scores = host_scores(df, threshold).select("host", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow").alias("by_graph"))
    df = df.drop("html")
    rows = df.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
    out = join_hot(df, stage(rows.join(scores, "host", "left")), ["host"], "rows", df.count())
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("verdict", "by_graph", F.lit("allow")).alias("verdict"))
