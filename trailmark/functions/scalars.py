"""Column expressions for text, number, date and URL values.

Every function takes and returns a Column, so it runs inside the scan stage of whatever
job uses it. Raw text goes through ``try_*`` functions because ANSI mode is on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
# Characters a Python ``str.strip()`` removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
NUMBER_TOKEN = r"[-+]?\d*\.\d+%?|[-+]?\d+\.?\d*%?"
FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
URL_TOKEN = (
    r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
)
# Year-first notations (2024-1-5, 2024/1/5, 2024年1月5日, 2024年1月, 2024-1, 2024) become one form a cast reads.
YEAR_FIRST = r"^\d{4}(-\d{1,2}){0,2}$"
YEAR_FIRST_MARKS = ("/年月日", "---")
# Other notations: (guard, parser pattern, suffix); the guard picks the one pattern worth trying.
DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", ""),
    (r"^\d{8}$", "yyyyMMdd", ""),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy", ""),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", ""),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy", ""),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", ""),
    (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy", ""),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy", ""),
    (r"^[A-Za-z]{4,9} \d{1,2}$", "MMMM d yyyy", " 2000"),
    (r"^[A-Za-z]{3} \d{1,2}$", "MMM d yyyy", " 2000"),
)
DATE_WINDOW_DAYS = 31
PREPROCESSORS = ("norm_str", "extract_number", "norm_date")
TRUE_WORDS = ("1", "true", "yes", "y")
HAN_MANY, HAN_SOME, HAN_SHARE = 8, 4, 0.05
# -------------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim every whitespace character, not only the space."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def first_nonempty(*cs: Column | str) -> Column:
    """The first operand that is neither null nor empty, else the empty text."""
    return F.coalesce(F.get(F.filter(F.array(*[col(c) for c in cs]), lambda t: t != ""), F.lit(0)), F.lit(""))


def norm_column(c: Column | str) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))


def norm_str(c: Column | str) -> Column:
    return F.translate(strip(F.lower(col(c))), " *", "")


def extract_number(c: Column | str) -> Column:
    """First number in the text once thousands commas are gone, else the text ``NULL``."""
    found = F.regexp_extract(F.translate(col(c), ",", ""), NUMBER_TOKEN, 0)
    return F.coalesce(blank_to_null(found), F.lit("NULL"))


def parse_date(c: Column | str) -> Column:
    """A date for the listed formats; missing parts become 2000, January and the first."""
    return let(strip(c), _date_of)


def _date_of(text: Column) -> Column:
    out = F.lit(None).cast("date")
    for guard, pattern, suffix in reversed(DATE_FORMATS):
        value = F.concat(text, F.lit(suffix)) if suffix else text
        out = F.when(text.rlike(guard), F.try_to_timestamp(value, F.lit(pattern)).cast("date")).otherwise(out)
    plain = F.rtrim(F.translate(text, *YEAR_FIRST_MARKS), F.lit("-"))
    return let(plain, lambda p: F.when(p.rlike(YEAR_FIRST), p.try_cast("date")).otherwise(out))


def norm_date(c: Column | str) -> Column:
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), col(c))


def preprocess_step(value: Column, name: Column) -> Column:
    """One named normalisation; an unknown name is an error at run time."""
    return (
        F.when(name == "norm_str", norm_str(value))
        .when(name == "extract_number", extract_number(value))
        .when(name == "norm_date", norm_date(value))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported preprocess function: "), name)))
    )


def preprocess(value: Column, names: Column) -> Column:
    """Apply a chain of named normalisations in order."""
    return F.aggregate(names, value, preprocess_step)


def exact_match(response: Column, target: Column) -> Column:
    return F.lower(response).eqNullSafe(F.lower(target)).cast("double")


def url_hosts(c: Column | str) -> Column:
    urls = F.regexp_extract_all(col(c), F.lit(f"({URL_TOKEN})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(urls, lambda u: F.regexp_extract(u, r"^https?://([^/?#]*)", 1))))


def url_match(response: Column, target: Column) -> Column:
    """Equal host sets; two texts without any URL agree."""
    return (url_hosts(response) == url_hosts(target)).cast("double")


def to_float(c: Column | str) -> Column:
    """Text to double by Python's rules for plain decimal text, ``inf`` and ``nan``."""
    return let(F.lower(strip(c)), _float_of)


def _float_of(text: Column) -> Column:
    return (
        F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
        .when(text.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(text.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(text.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    )


def number_or_percent(c: Column | str) -> Column:
    text = col(c)
    scale = F.when(F.contains(text, F.lit("%")), F.lit(100.0)).otherwise(F.lit(1.0))
    return to_float(F.replace(text, F.lit("%"), F.lit(""))) / scale


def number_near(response: Column, target: Column, criterion: Column) -> Column:
    """Relative tolerance on the target; two non-numbers must be the same text."""
    pair = F.struct(number_or_percent(response).alias("r"), number_or_percent(target).alias("t"))
    return let(pair, lambda p: numbers_agree(p["r"], p["t"], response, target, criterion).cast("double"))


def numbers_agree(r: Column, t: Column, response: Column, target: Column, criterion: Column) -> Column:
    """As ``number_near`` for numbers that are parsed already."""
    reach = F.abs(t) * criterion
    near = (~F.isnan(r)) & (~F.isnan(t)) & (~F.isnan(reach)) & (F.abs(r - t) <= reach)
    return F.when(r.isNull() & t.isNull(), response.eqNullSafe(target)).when(r.isNull() | t.isNull(), F.lit(False)).otherwise(near)


def date_near(response: Column, target: Column) -> Column:
    """Within the day window; two unparseable dates agree."""
    pair = F.struct(parse_date(response).alias("r"), parse_date(target).alias("t"))
    return let(pair, lambda p: days_agree(F.unix_date(p["r"]), F.unix_date(p["t"])).cast("double"))


def days_agree(r: Column, t: Column) -> Column:
    """As ``date_near`` for day numbers that are parsed already."""
    return F.when(r.isNull() & t.isNull(), F.lit(True)).when(r.isNull() | t.isNull(), F.lit(False)).otherwise(F.abs(r - t) <= DATE_WINDOW_DAYS)


def detect_language(c: Column | str) -> Column:
    return F.when(col(c).rlike(HAN), F.lit("zh")).otherwise(F.lit("en"))


def prompt_language(c: Column | str) -> Column:
    """``zh`` only when the text holds a material amount of Han characters."""
    han = F.length(F.regexp_replace(col(c), HAN.replace("[", "[^", 1), ""))
    solid = F.length(F.translate(col(c), WHITESPACE, ""))
    material = (han >= HAN_MANY) | ((han >= HAN_SOME) & (han >= solid * HAN_SHARE))
    return F.when((solid > 0) & material, F.lit("zh")).otherwise(F.lit("en"))


def fold_key(c: Column | str) -> Column:
    """Whitespace-folded, lower-cased comparison key."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), F.lit(1)))


def harmonic_mean(precision: Column, recall: Column, floor: float = 0.0) -> Column:
    """F1, zero when the sum does not exceed ``floor`` (1e-9 for tables, 0 for components)."""
    return F.when(precision + recall > floor, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double, zero over an empty denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def as_text_list(c: Column | str) -> Column:
    """Scalar text to a one-element list; null to the empty list."""
    return F.when(col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(col(c).cast("string")))


def char_count(*parts: Column) -> Column:
    """Characters over all text parts; a null part has none."""
    total = F.lit(0)
    for part in parts:
        total = total + F.coalesce(F.length(part), F.lit(0))
    return total


def call_chars(calls: Column) -> Column:
    """Characters of the names and arguments of a VARIANT list of tool calls, flat or under ``function``.

    Arguments that are no text count as compact JSON. Null and anything but a list have none.
    """
    text = lambda c, path: F.coalesce(F.length(F.try_variant_get(c, path, "string")), F.lit(0))

    def one(call: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(call, "$.function", "variant"), call)
        return text(inner, "$.name") + text(inner, "$.arguments")

    listed = F.coalesce(calls.try_cast("array<variant>"), F.array().cast("array<variant>"))
    return F.aggregate(listed, F.lit(0), lambda total, call: total + F.coalesce(one(call), F.lit(0)))


def token_estimate(*parts: Column, calls: Column | None = None) -> Column:
    """Characters over all text parts of a row, and of its tool calls, divided by four, floored once."""
    return F.floor(_chars(parts, calls) / 4).cast("bigint")


def token_total(*parts: Column, calls: Column | None = None) -> Column:
    """Aggregate: characters over all rows of a group divided by four, floored once."""
    return F.floor(F.sum(_chars(parts, calls)) / 4).cast("bigint")


def _chars(parts: tuple[Column, ...], calls: Column | None) -> Column:
    return char_count(*parts) if calls is None else char_count(*parts) + call_chars(calls)


def loop_notice(cycle: Column, language: Column) -> Column:
    """Text returned in place of a blocked call; the caller's language picks the wording."""
    repeats = F.when(cycle == 1, 3).otherwise(2).cast("string")
    n = cycle.cast("string")
    en = F.when(
        cycle == 1, F.concat(F.lit("Blocked: this identical call was issued "), repeats, F.lit(" turns in a row."))
    ).otherwise(F.concat(F.lit("Blocked: the same "), n, F.lit(" calls were cycled for "), repeats, F.lit(" rounds.")))
    zh = F.when(cycle == 1, F.concat(F.lit("已拦截：同一调用连续发起 "), repeats, F.lit(" 轮。"))).otherwise(
        F.concat(F.lit("已拦截：同样的 "), n, F.lit(" 个调用循环了 "), repeats, F.lit(" 轮。"))
    )
    return F.when(language == "zh", zh).otherwise(en)
