"""Column expressions on issue numbers, dates, money, number arrays and tickets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tax: the whole of a gross above the limit is taxed.
TAX_LIMIT, TAX_RATE = 10_000, 0.2


def issue_key(issue: Column) -> Column:
    """struct(year, seq) of an issue number of 7+, 5 or 4 digits; null for anything else."""
    digits = F.regexp_replace(issue, "[^0-9]", "")
    n = F.length(digits)
    part = lambda a, b: F.substring(digits, F.lit(a), b).cast("int")
    two = part(1, F.lit(2))
    year = F.when(n >= 7, part(1, F.lit(4))).when(n == 5, F.when(two < 90, two + 2000).otherwise(two + 1900)).when(n == 4, part(1, F.lit(1)) + 2000)
    seq = F.when(n >= 7, part(5, n)).when(n == 5, part(3, n)).when(n == 4, part(2, n))
    return F.when(year.isNotNull(), F.struct(year.alias("year"), seq.alias("seq")))


def parse_draw_date(text: Column) -> Column:
    """First format that fits; null for blanks and ``#`` marks."""
    text = F.trim(text)
    formats = ("d/M/yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyyMMdd")
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.when((text != "") & ~text.startswith("#"), F.coalesce(*tried))


def to_int_money(text: Column) -> Column:
    """Whole amount of a text with thousands separators; null if blank or no number."""
    return F.round(F.trim(F.regexp_replace(text, "[,，]", "")).try_cast("double")).cast("bigint")


def shape_features(numbers: Column, size: int = 33) -> dict[str, Column]:
    """Sum, span, odd count, consecutive pairs, gaps, tail repeats, runs, arithmetic complexity, halves, thirds and shares of low numbers.

    Of distinct numbers from 1 to ``size``, in any order.
    """
    s = F.array_sort(numbers)
    n = F.size(s)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(s, i + 1) - F.element_at(s, i))
    count = lambda a, f: F.size(F.filter(a, f))
    differences = F.array_distinct(F.flatten(F.transform(s, lambda a: F.filter(F.transform(s, lambda b: b - a), lambda d: d > 0))))
    tails = F.transform(s, lambda x: x % 10)
    repeats = F.aggregate(F.array_distinct(tails), F.lit(0), lambda acc, t: acc + (count(tails, lambda u: u == t) * (count(tails, lambda u: u == t) - 1) / 2).cast("int"))
    run = F.aggregate(gaps, F.struct(F.lit(1).alias("run"), F.lit(1).alias("best")), lambda a, g: F.struct(F.when(g == 1, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(g == 1, a["run"] + 1).otherwise(1)).alias("best")))["best"]
    groups = F.aggregate(gaps, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), lambda a, g: F.struct((a["n"] + F.when((g == 1) & ~a["inside"], 1).otherwise(0)).alias("n"), (g == 1).alias("inside")))["n"]
    low = count(s, lambda x: x <= size // 2)
    thirds = [count(s, lambda x: (x > lo) & (x <= hi)) for lo, hi in ((0, size // 3), (size // 3, 2 * size // 3), (2 * size // 3, size))]
    return {
        "total": F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x),
        "span": (F.element_at(s, -1) - F.element_at(s, 1)).cast("bigint"),
        "odd": count(s, lambda x: x % 2 == 1).cast("bigint"),
        "pairs": count(gaps, lambda g: g == 1).cast("bigint"),
        "min_gap": F.array_min(gaps).cast("bigint"),
        "max_gap": F.array_max(gaps).cast("bigint"),
        "tail_repeats": repeats.cast("bigint"),
        "longest_run": run.cast("bigint"),
        "run_groups": groups.cast("bigint"),
        "triple": run >= 3,
        "complexity": (F.size(differences) - (n - 1)).cast("bigint"),
        "low": low.cast("bigint"),
        "high": (n - low).cast("bigint"),
        "skew": F.abs(2 * low - n).cast("bigint"),
        **{f"third{i}": t.cast("bigint") for i, t in enumerate(thirds, 1)},
        "share12": F.round(count(s, lambda x: x <= 12) / n, 6),
        "share31": F.round(count(s, lambda x: x <= 31) / n, 6),
    }


def tax(gross: Column) -> Column:
    return F.when(gross > TAX_LIMIT, gross * TAX_RATE).otherwise(F.lit(0.0))


def tax_of_issue(amounts: Column, basis: str) -> Column:
    """Tax on an issue's ticket amounts: of their sum (``issue_aggregate``) or of each (``per_ticket``)."""
    if basis == "issue_aggregate":
        return tax(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x))
    if basis == "per_ticket":
        return F.aggregate(amounts, F.lit(0.0), lambda a, x: a + tax(x))
    raise ValueError(f"no such basis: {basis}")


def number_mask(numbers: Column) -> Column:
    """Numbers 1..63 as the bits of a long."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))))


def zone_hits(ticket: Column, draw: Column) -> Column:
    """Numbers in common, over masks."""
    return F.bit_count(ticket.bitwiseAND(draw))


def is_valid_prediction(generated: Column, draw_date: Column, predicted: Column | None = None, source: Column | None = None) -> Column:
    """Made by 21:00 of the draw day; else by the day ``predicted``; with neither, valid.  Training records are not."""
    limit = draw_date.cast("timestamp") + F.expr("interval 21 hours")
    by_day = F.lit(None).cast("boolean") if predicted is None else predicted <= draw_date
    valid = F.coalesce(generated <= limit, by_day, F.lit(True))
    return valid if source is None else valid & ~F.coalesce(source == "train", F.lit(False))


def norm_numbers(texts: Column) -> Column:
    """Trimmed texts as ints, blanks dropped; null if any is no whole number."""
    cut = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.forall(cut, lambda x: x.rlike(r"\A[+-]?[0-9]+\z")), F.transform(cut, lambda x: x.try_cast("int")))


#: Regions as winner texts name them, and other spellings.
REGIONS = "北京 天津 河北 山西 内蒙古 辽宁 吉林 黑龙江 上海 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 广西 海南 重庆 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆 深圳".split()
ALIASES = {"内蒙": "内蒙古", "广西壮族": "广西", "宁夏回族": "宁夏", "新疆维吾尔": "新疆", "西藏自治区": "西藏"}


def region_name(name: Column) -> Column:
    """A region under its usual name."""
    out = name
    for short, full in ALIASES.items():
        out = F.when(name == short, full).otherwise(out)
    return out


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u3000]+", "")


def parse_region_text(text: Column) -> Column:
    """array<struct(region, winners)> of a winner text, in the order in which regions come first.

    White space goes, and what follows 其中 (a breakdown of what was said).  In
    brackets, open at the very end too, counts the basic number, or without one
    the first number; only a text without brackets is read as region and number.
    Repeated regions are added up, zeros dropped; anything else is no region.
    """
    s = F.substring_index(_squeezed(text), "其中", 1)
    names = "|".join(sorted({*REGIONS, *ALIASES}, key=lambda r: (-len(r), r)))
    first = lambda x, pattern: F.regexp_extract(x, pattern, 1).try_cast("int")
    inner = lambda x: F.coalesce(first(x, r"基本(\d+)注"), first(x, r"(\d+)注"), F.lit(0))
    pair = lambda x, n: F.struct(region_name(F.regexp_extract(x, f"^({names})", 1)).alias("region"), n.alias("winners"))
    closed = F.transform(F.regexp_extract_all(s, F.lit(rf"(?:{names})[(（][^)）]*[)）]"), F.lit(0)), lambda x: pair(x, inner(x)))
    tail = F.regexp_extract(s, rf"((?:{names})[(（][^)）]*)$", 1)
    tailed = F.when(tail != "", F.array(pair(tail, inner(tail)))).otherwise(F.array().cast("array<struct<region:string,winners:int>>"))
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)  # x is worked out once, however often it is used
    seen = lambda c: F.transform(F.filter(c, lambda r: r["winners"] > 0), lambda r: r["region"])
    bracketed = once(closed, lambda c: F.concat(c, F.filter(tailed, lambda r: ~F.array_contains(seen(c), r["region"]))))
    plain = F.transform(F.regexp_extract_all(s, F.lit(rf"(?:{names})\d+注"), F.lit(0)), lambda x: pair(x, first(x, r"(\d+)注")))
    some = lambda a: F.filter(a, lambda r: r["winners"] > 0)
    found = once(some(bracketed), lambda b: F.when(F.size(b) > 0, b).otherwise(some(plain)))
    total = lambda f, name: F.aggregate(F.filter(f, lambda r: r["region"] == name), F.lit(0), lambda a, r: a + r["winners"])
    return once(found, lambda f: F.transform(F.array_distinct(F.transform(f, lambda r: r["region"])), lambda name: F.struct(name.alias("region"), total(f, name).alias("winners"))))


def parse_total(text: Column) -> Column:
    """The stated total of a winner text; null without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"共\s*(\d+)\s*注", 1).try_cast("int")


def parse_non_region_buckets(text: Column) -> Column:
    """Winners that belong to no region (points exchanged for tickets), added up."""
    found = F.regexp_extract_all(_squeezed(text), F.lit(r"积分换彩(\d+)注"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.try_cast("int"))


#: Old names of digit positions, from the right and from the left.
FROM_RIGHT = ("个位", "十位", "百位", "千位", "万位")
FROM_LEFT = tuple(f"第{c}位" for c in "一二三四五六七")


def norm_zone_names(zones: Column, n_zones: int) -> Column:
    """A map's old position names as 第1位 to 第Nth位; other names stay."""
    names = {old: f"第{n_zones - i}位" for i, old in enumerate(FROM_RIGHT) if n_zones > i}
    names |= {old: f"第{i}位" for i, old in enumerate(FROM_LEFT, 1) if i <= n_zones}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map()
    return F.map_from_entries(F.transform(F.map_entries(zones), lambda e: F.struct(F.coalesce(F.try_element_at(table, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))


def norm_grade(name: Column) -> Column:
    """A grade's name without its prize mark."""
    return F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("奖"), F.lit(""))


def norm_level_name(name: Column) -> Column:
    """struct(grade, is_award, is_addon) of a prize level's name, such as 三等奖派奖; x10z9 names a play and its hits."""
    s = F.trim(F.coalesce(name, F.lit("")))
    bare = s
    for mark in ("基本派奖", "派奖", "追加", "基本"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    numbers = F.array(*map(F.lit, "零一二三四五六七八九十"))
    play, hit = (F.regexp_extract(bare, r"^x(\d{1,2})z(\d{1,2})$", i).try_cast("int") for i in (1, 2))
    chosen = F.when((play <= 10) & (hit <= 10), F.concat(F.lit("选"), F.get(numbers, play), F.lit("中"), F.get(numbers, hit)))
    grade = F.when(bare.rlike("^[一二三四五六七八九十]+等"), F.concat(F.regexp_extract(bare, "^([一二三四五六七八九十]+)等", 1), F.lit("等"))).otherwise(F.coalesce(chosen, bare))
    return F.struct(F.trim(grade).alias("grade"), s.contains("派奖").alias("is_award"), s.contains("追加").alias("is_addon"))


def norm_strategy(name: Column) -> Column:
    """All names of the model family as one."""
    return F.when(name.contains("ML") | name.contains("统计训练"), "ML策略").otherwise(name)


def pattern_flags(numbers: Column, size: int) -> Column:
    """What players like about a combination: run, low or high half only, three terms in steps, birthdays."""
    s = F.array_sort(numbers)
    low = size // 2
    three = lambda step: F.exists(s, lambda a: F.exists(s, lambda b: (b > a) & (F.array_contains(s, 2 * b - a) if step is None else (b == a + step) & F.array_contains(s, a + 2 * step))))
    flags = (
        ("run", three(1)), ("low", F.forall(s, lambda x: x <= low)), ("high", F.forall(s, lambda x: x >= low + 2)), ("steps", three(None)), ("birthdays", F.size(F.filter(s, lambda x: x <= 12)) >= 4),
    )
    return F.filter(F.array(*(F.when(c, n) for n, c in flags)), lambda x: x.isNotNull())


def digit_penalty(digits: Column) -> Column:
    """How much players like a digit row: dates, one digit only, straights, palindromes, eights, equal ends."""
    n = F.size(digits)
    at = lambda i: F.get(digits, F.lit(i))
    date = (n >= 4) & (at(0) * 10 + at(1)).between(1, 12) & (at(2) * 10 + at(3)).between(1, 31)
    straight = F.exists(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: (F.get(digits, i) + 1 == F.get(digits, i + 1)) & (F.get(digits, i + 1) + 1 == F.get(digits, i + 2)))
    points = (
        (date, 3), (F.size(F.array_distinct(digits)) == 1, 3), (straight, 2), (digits == F.reverse(digits), 2), (F.size(F.filter(digits, lambda x: x == 8)) >= 2, 1), ((n >= 2) & (at(0) == F.get(digits, n - 1)), 1),
    )
    return sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)).cast("bigint")


def check_constraints(numbers: Column, sum_range=None, odd_range=None, max_repeat=None, max_consec=None) -> Column:
    """Whether a row of numbers keeps to all limits given."""
    ok = F.lit(True)
    if sum_range:
        ok = ok & F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).between(*sum_range)
    if odd_range:
        ok = ok & F.size(F.filter(numbers, lambda x: x % 2 == 1)).between(*odd_range)
    if max_repeat:
        ok = ok & F.forall(numbers, lambda x: F.size(F.filter(numbers, lambda y: y == x)) <= max_repeat)
    if max_consec:
        step = lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(x == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("best"))
        best = F.aggregate(numbers, F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best")), lambda a, x: step(a, x.cast("bigint")))["best"]
        ok = ok & (best <= max_consec)
    return ok


def play_of_width(width: Column) -> Column:
    """The play of a ticket with 1 to 10 numbers of the 80-number game."""
    return F.when(width.between(1, 10), F.concat(F.lit("选"), F.get(F.array(*map(F.lit, "零一二三四五六七八九十")), width.cast("int"))))


def digit_shape(digits: Column) -> Column:
    """all_equal, pair or distinct, of three digits."""
    return F.when(F.size(digits) == 3, F.get(F.array(F.lit("all_equal"), F.lit("pair"), F.lit("distinct")), F.size(F.array_distinct(digits)) - 1))


def cum_win_prob(p: Column, n: Column) -> Column:
    return 1 - F.pow(1 - p, n)


def kelly(p: Column, odds: Column) -> Column:
    """Share to bet at net ``odds``; none without an edge."""
    return F.greatest(F.lit(0.0), (odds * p - (1 - p)) / odds)


def expected_dups(n: Column, space: float) -> Column:
    """Expected equal pairs among n draws from ``space`` combinations."""
    return n * (n - 1) / (2.0 * space)


def random_hits(size: int, drawn: int, ticket: int) -> tuple[float, float]:
    """Mean and variance of the hits of a random ticket."""
    mean = ticket * drawn / size
    return mean, mean * (size - drawn) / size * (size - ticket) / (size - 1)


def ticket_fingerprint(tickets: Column) -> Column:
    """SHA-256 of an ordered ticket list (array of number arrays): the same list, the same mark."""
    return F.sha2(F.to_json(tickets), 256)
