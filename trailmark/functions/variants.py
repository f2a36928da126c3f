"""Reading free-form JSON values (metrics, arguments, metadata) held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.scalars import FLOAT_TEXT, TRUE_WORDS, col, strip

NUMERIC_KINDS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def parsed(df: DataFrame, name: str) -> Column:
    """The named column as VARIANT, whether it is stored as JSON text or already parsed."""
    if isinstance(df.schema[name].dataType, T.VariantType):
        return F.col(name)
    return F.try_parse_json(F.col(name))


def at(v: Column | str, path: str = "$") -> Column:
    return F.try_variant_get(col(v), path, "variant")


def kind(v: Column | str) -> Column:
    """VARIANT type name; null when the path is absent."""
    return F.schema_of_variant(col(v))


def text_at(v: Column | str, path: str) -> Column:
    """Value as text; objects and arrays as JSON, absent and JSON null as null."""
    return F.try_variant_get(col(v), path, "string")


def is_object(v: Column | str) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def present(v: Column | str) -> Column:
    """True unless the value is absent or JSON null."""
    return F.coalesce(kind(v) != "VOID", F.lit(False))


def truthy(v: Column | str) -> Column:
    """Python truth of a JSON value."""
    leaf = col(v)
    k = kind(leaf)
    text = leaf.try_cast("string")
    return F.coalesce(
        F.when(k == "BOOLEAN", text == "true")
        .when(k == "STRING", text != "")
        .when(k.rlike(NUMERIC_KINDS), text.try_cast("double") != 0)
        .when(k == "VOID", F.lit(False))
        .when(k.startswith("ARRAY"), text != "[]")
        .when(k.startswith("OBJECT"), text != "{}"),
        F.lit(False),
    )


def strictly_true(v: Column | str) -> Column:
    """JSON ``true`` only: the text ``"true"`` and the number 1 do not count."""
    leaf = col(v)
    return F.coalesce((kind(leaf) == "BOOLEAN") & (leaf.try_cast("string") == "true"), F.lit(False))


def finite_number(v: Column | str) -> Column:
    """Finite double from a number or decimal text; booleans, NaN and infinities give null."""
    leaf = col(v)
    k = kind(leaf)
    text = strip(leaf.try_cast("string"))
    number = F.when(k.rlike(NUMERIC_KINDS), text.try_cast("double")).when(
        (k == "STRING") & text.rlike(FLOAT_TEXT), text.try_cast("double")
    )
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def finite_or_zero(v: Column | str) -> Column:
    return F.coalesce(finite_number(v), F.lit(0.0))


def loose_bool(v: Column | str) -> Column:
    leaf = col(v)
    word = F.lower(strip(leaf.try_cast("string")))
    return F.when(kind(leaf) == "STRING", word.isin(*TRUE_WORDS)).otherwise(truthy(leaf))


def loose_int(v: Column | str) -> Column:
    """Integer from a boolean, a number (truncated) or integer text, else null."""
    leaf = col(v)
    k = kind(leaf)
    text = strip(leaf.try_cast("string"))
    return (
        F.when(k == "BOOLEAN", (text == "true").cast("bigint"))
        .when(k == "BIGINT", text.try_cast("bigint"))
        .when(k.rlike(NUMERIC_KINDS), text.try_cast("double").try_cast("bigint"))
        .when((k == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    )


def decoded(c: Column | str) -> Column:
    """JSON text to its value; any other text to a string value."""
    return F.coalesce(F.try_parse_json(col(c)), F.to_variant_object(F.struct(col(c).alias("t"))).try_cast("variant"))


#: A JSON string with a colon behind it if it is a key, or what stands between strings.
JSON_PART = r'"(?:[^"\\]++|\\.)*+"\s*+:?|[^"]++'


def _folded(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), r"\s+", " "))


def _folded_json(text: Column) -> Column:
    """JSON text with every string value trimmed, its white space folded and lower-cased; keys stay."""
    parts = F.regexp_extract_all(text, F.lit(JSON_PART), F.lit(0))

    def part(p: Column) -> Column:
        inner = F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r"\\[nrtf]", " ")
        return F.when(p.startswith('"') & p.endswith('"'), F.concat(F.lit('"'), _folded(inner), F.lit('"'))).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def call_signature(name: Column, raw_arguments: Column) -> Column:
    """Tool name, NUL, and the arguments with sorted keys and folded text values, nested ones too.

    Undecodable arguments are compared as folded text; an object stands in braces, so that one without fields is no blank text.
    """
    fields = F.from_json(raw_arguments, "map<string,variant>")
    rendered = F.array_join(
        F.transform(
            F.array_sort(F.map_keys(fields)),
            lambda k: F.concat(
                F.to_json(F.struct(k.alias("k"))),
                F.coalesce(
                    F.when(F.schema_of_variant(fields[k]) == "STRING", F.concat(F.lit("s:"), _folded(fields[k].try_cast("string"))))
                    .otherwise(F.concat(F.lit("j:"), _folded_json(F.to_json(fields[k])))),
                    F.lit("j:null"),
                ),
            ),
        ),
        "\x1f",
    )
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(raw_arguments)).startswith("OBJECT"), F.lit(False))
    return F.concat(name, F.lit("\x00"), F.when(good, F.concat(F.lit("{"), rendered, F.lit("}"))).otherwise(_folded(raw_arguments)))
