"""Text normalisation, parsing and display expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from periodica.functions.folding import fold_compatible
from periodica.functions.measures import as_col

def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with a value that is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# fixed values: full-width marks and their half-width forms
WIDE_MARKS, NARROW_MARKS = "（）：　", "(): "


def normalise_name(value: Column | str) -> Column:
    """Half-width brackets and colons; words, and what follows a colon, stand one space apart."""
    parts = F.split(F.translate(as_col(value), WIDE_MARKS, NARROW_MARKS), ":")
    words = F.split(F.array_join(parts, ": "), r"\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


# fixed values: marks that shed the spaces around them
TIGHT_MARKS = r":：,，()（）\[\]【】{}\-—·.。"


def normalise_text(value: Column | str, lower: bool = True) -> Column:
    """Compatibility forms folded, no spaces around marks, lower case."""
    c = fold_compatible(F.coalesce(as_col(value).cast("string"), F.lit("")))
    c = F.trim(c)
    c = F.regexp_replace(c, f" ?([{TIGHT_MARKS}]) ?", "$1")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    if not lower:
        return c
    return F.when(c.rlike(r"[\x00-\x7F]"), F.lower(c)).otherwise(c)


# fixed values: the brackets of remarks
OPENING, CLOSING = "（(", "）)"


def strip_parentheses(value: Column | str) -> Column:
    """Text without bracketed remarks, at any depth, and without the blanks before them.

    One pass over the marks keeps the text so far and where each open bracket
    stands in it; a closing one cuts the text back to the last of its kind. Brackets
    without a partner stay.
    """
    c = as_col(value)
    pieces = F.regexp_extract_all(c, F.lit(f"[{OPENING}{CLOSING}]|[^{OPENING}{CLOSING}]+"), F.lit(0))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<closes:string,at:int>>").alias("open"))

    def read(seen: Column, piece: Column) -> Column:
        partners = F.filter(seen["open"], lambda o: o["closes"] == piece)
        longer = F.concat(seen["text"], piece)
        at = F.element_at(partners, -1)["at"]
        cut = F.regexp_replace(F.substring(seen["text"], F.lit(1), at), r"\s+$", "")
        opened = F.concat(seen["open"], F.array(F.struct(F.translate(piece, OPENING, CLOSING).alias("closes"), F.length(seen["text"]).alias("at"))))
        return F.when(piece.isin(*OPENING), F.struct(longer.alias("text"), opened.alias("open"))).when(
            F.size(partners) > 0, F.struct(cut.alias("text"), F.filter(seen["open"], lambda o: o["at"] < at).alias("open"))).otherwise(
            F.struct(longer.alias("text"), seen["open"].alias("open")))

    return F.trim(F.aggregate(pieces, start, read)["text"])


def translate_sources(value: Column | str, names: dict[str, str]) -> Column:
    """Known source names replaced part by part, remarks stripped, parts rejoined."""
    parts = F.filter(F.transform(F.split(as_col(value), "[、；]"), lambda p: F.trim(p)), lambda p: p != "")
    if names:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        parts = F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p))
    return F.array_join(F.transform(parts, lambda p: strip_parentheses(p)), "、")


def parse_month(value: Column | str) -> Column:
    """First day of the month of a loosely written date, NULL when unreadable."""
    s = F.trim(F.regexp_replace(F.trim(as_col(value).cast("string")), '^"+|"+$', ""))
    n = F.when(s.rlike(r"^\d{1,18}$"), s.try_cast("double"))
    sec = F.when(n > 1e12, n / 1000.0).otherwise(n)
    epoch = F.when((sec > 1e9) & (sec < 4.1e9), F.to_date(F.timestamp_seconds(sec)))
    part = F.substring(F.split_part(F.regexp_replace(s, "T", " "), F.lit(" "), F.lit(1)), 1, 10)

    def ymd(pattern: str, y: int, m: int, d: int) -> Column:
        g = lambda i: F.regexp_extract(part, pattern, i)
        text = F.concat_ws("-", F.lpad(g(y), 4, "0"), F.lpad(g(m), 2, "0"), F.lpad(g(d), 2, "0"))
        return F.when(part.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd"))

    year_first = [ymd(rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})$", 1, 2, 3) for sep in ("-", "/", r"\.")]
    day_first = [ymd(rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", 3, 2, 1) for sep in ("/", "-", r"\.")]
    month_first = ymd(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2)
    plain = ymd(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3)
    found = F.coalesce(epoch, plain, *year_first, day_first[0], month_first, *day_first[1:])
    return F.trunc(found, "MM")


def parse_utc(value: Column | str) -> Column:
    """ISO text with or without an offset to a UTC timestamp, else NULL."""
    s = F.trim(as_col(value).cast("string"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))


def standard_date(value: Column | str) -> Column:
    return F.date_format(F.coalesce(as_col(value).try_cast("date"), F.trunc(parse_month(value), "MM")), "yyyy-MM-dd")


# fixed values: display scales
DISPLAY_SCALES = (("万亿", 1e12), ("百亿", 1e10), ("十亿", 1e9), ("亿", 1e8), ("千万", 1e7), ("百万", 1e6), ("万", 1e4), ("百", 1e2))


def display_number(value: Column) -> Column:
    """Thousands separators, at most two decimals, no trailing zeros."""
    text = F.format_number(value, 2)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_scaled(value: Column, unit: str, scale: float = 1.0) -> Column:
    base = value * scale
    out = None
    for prefix, factor in DISPLAY_SCALES:
        text = F.concat(display_number(base / factor), F.lit(f" {prefix}{unit}"))
        out = F.when(F.abs(base) >= factor, text) if out is None else out.when(F.abs(base) >= factor, text)
    return F.when(~F.isnan(base), out.otherwise(F.concat(display_number(base), F.lit(f" {unit}"))))


def format_count(value: Column, unit: str) -> Column:
    """Plain below a thousand, then stepped units; the steps are fixed values."""
    steps = ((1e7, 1e4, "万"), (1e8, 1e7, "千万"), (1e9, 1e8, "亿"), (1e10, 1e9, "十亿"))
    m = F.abs(value)
    out = F.when(m < 1000, F.concat(F.format_number(value, 0), F.lit(f" {unit}")))
    for below, factor, prefix in steps:
        out = out.when(m < below, F.concat(display_number(value / factor), F.lit(f" {prefix}{unit}")))
    return F.when(value.isNotNull() & ~F.isnan(value), out.otherwise(F.concat(display_number(value / 1e10), F.lit(f" 百亿{unit}"))))


def format_currency(value: Column, currency: str, scale: float = 1.0) -> Column:
    base = value * scale
    hundred_million = base / 1e8
    small = F.concat(display_number(hundred_million), F.lit(f" 亿{currency}"))
    return F.when(F.abs(hundred_million) < 1000, small).otherwise(F.concat(display_number(base / 1e12), F.lit(f" 万亿{currency}")))


# fixed values: words that make a bound open, words for "about", marks of a range, and unit factors
OPEN_BOUNDS = (">", "<", "以上", "以下", "超过", "至少", "不低于", "不超过")
ABOUT = ("约", "大约", "近", "≈", "~")
RANGE_MARKS = ("–", "—", "−", "~", "至", "-")
RATE_UNITS = {"千桶/日": 10, "千桶油当量/日": 10, "桶/日": 10000, "百万立方米/日": 1, "百万标准立方英尺/日": 1}


def _rate_divisor(unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RATE_UNITS.items() for x in kv])[unit]


def _plain(value: Column) -> Column:
    return F.trim(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit(","), F.lit("")))


def leading_number(text: Column) -> tuple[Column, Column]:
    """The number that a text begins with (empty without one), and the text behind it without outer blanks."""
    number = F.regexp_extract(text, r"^(?:\d+(?:\.\d+)?|\.\d+)", 0)
    return number, F.trim(F.substring(text, F.length(number) + 1, F.length(text)))


def daily_rate(value: Column, qualifier: Column, unit: Column) -> Column:
    """Daily rate from text as (amount, midpoint); open bounds and reversed ranges give NULL.

    Read from left to right: a word for "about", a number, and for a range its
    mark and a second number; nothing else may follow.
    """
    raw = _plain(value)
    whole = F.concat(raw, F.coalesce(qualifier, F.lit("")))
    is_open = bound(whole, lambda text: F.exists(F.array(*map(F.lit, OPEN_BOUNDS)), lambda w: F.contains(text, w)))

    def without_about(r: Column) -> Column:
        said = F.filter(F.array(*[F.lit(w) for w in sorted(ABOUT, key=len, reverse=True)]), lambda w: F.startswith(r, w))
        return F.when(F.size(said) > 0, F.trim(F.substring(r, F.length(said[0]) + 1, F.length(r)))).otherwise(r)

    def numbers(text: Column) -> Column:
        first, rest = leading_number(text)
        return F.struct(first.alias("first"), rest.alias("rest"), *[c.alias(n) for n, c in zip(("second", "after"), leading_number(F.trim(F.substring(rest, F.lit(2), F.length(rest)))))])

    def read(n: Column) -> Column:
        low, high = n["first"].try_cast("double"), n["second"].try_cast("double")
        single = (n["first"] != "") & (n["rest"] == "")
        span = (n["first"] != "") & F.substring(n["rest"], 1, 1).isin(*RANGE_MARKS) & (n["second"] != "") & (n["after"] == "") & (high >= low)
        amount = F.when(single, low).when(span, (low + high) / 2)
        return F.struct(amount.alias("amount"), F.coalesce(span, F.lit(False)).alias("midpoint"))

    found = bound(bound(bound(raw, without_about), numbers), read)
    return F.struct(F.when(~is_open, found["amount"] / _rate_divisor(unit)).alias("amount"), (~is_open & found["midpoint"]).alias("midpoint"))


def plain_amount(value: Column, qualifier: Column, unit: Column) -> Column:
    """A rate written as a bare number, without a qualifier."""
    raw = _plain(value)
    number, rest = leading_number(raw)
    ok = (number != "") & (rest == "") & ~F.startswith(raw, F.lit(".")) & (F.coalesce(qualifier, F.lit("")) == "")
    return F.when(ok, raw.try_cast("decimal(28,8)") / _rate_divisor(unit))


def _period_words() -> list[tuple[str, bool | None, bool, str, int]]:
    """(words behind the year, behind its year mark or not, average said somewhere, code behind the year, last month).

    ``None`` for the mark: either way. The words are fixed values.
    """
    out = [(f"{lead}{mark}季度平均", None, False, f"-Q{q}", 3 * q) for lead in ("", "第") for q, pair in enumerate(("1一", "2二", "3三", "4四"), 1) for mark in pair]
    out += [("上半年", None, True, "-H1", 6), ("下半年", None, True, "-H2", 12)]
    out += [(f"{m}月平均", True, False, f"-{int(m):02d}", int(m)) for m in [*map(str, range(1, 13)), *(f"0{i}" for i in range(1, 10))]]
    return out + [("历史日均", True, False, "", 12), ("平均", True, False, "", 12), ("全年平均", False, False, "", 12), ("全年", False, True, "", 12)]


def observation_period(text: Column) -> Column:
    """(code, end) of a reporting period written in words: its year, and the first known words behind it.

    A date at the start has an end but no code.
    """
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(mark).cast("boolean").alias("mark"), F.lit(2 if name == "全年" else int(said)).alias("said"), F.lit(code).alias("code"), F.lit(last).alias("last"))
        for name, mark, said, code, last in _period_words()])

    def split(t: Column) -> Column:
        rest = F.substring(t, F.lit(5), F.length(t))
        marked = F.startswith(rest, F.lit("年"))
        words = F.when(marked, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
        says = F.when(F.contains(t, F.lit("日均")), 2).when(F.contains(t, F.lit("平均")), 1).otherwise(0)
        return F.struct(t.alias("t"), F.when(t.rlike(r"^\d{4}"), F.substring(t, 1, 4)).alias("year"), marked.alias("marked"), words.alias("words"), says.alias("says"))

    def known(p: Column) -> Column:
        hits = F.filter(table, lambda k: F.startswith(p["words"], k["name"]) & (k["mark"].isNull() | (k["mark"] == p["marked"])) & (p["says"] >= k["said"]))
        day = F.when(p["t"].rlike(r"^\d{4}-\d\d-\d\d"), F.substring(p["t"], 1, 10).try_cast("date"))
        return F.struct(p["year"].alias("year"), F.when(p["year"].isNotNull(), F.get(hits, F.lit(0))).alias("hit"), day.alias("day"))

    def named(k: Column) -> Column:
        month = F.last_day(F.make_date(k["year"].cast("int"), k["hit"]["last"], F.lit(1)))
        return F.struct(F.concat(k["year"], k["hit"]["code"]).alias("code"), F.when(k["hit"].isNotNull(), month).otherwise(k["day"]).alias("end"))

    return bound(bound(bound(F.coalesce(text, F.lit("")), split), known), named)


def guard_formula(value: Column | str) -> Column:
    """A leading apostrophe for text a spreadsheet would run as a formula."""
    c = as_col(value)
    return F.when(c.rlike(r"^[\s\x{FEFF}]*[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)
