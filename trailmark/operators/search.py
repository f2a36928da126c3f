"""Search responses: shaping, blocked domains, query echoes, first results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V

# ---- fixed values -------------------------------------------------------------------------
ECHO_OVERLAP = 0.9
ECHO_MAX_CHARS = 30
KEYS = ("title", "url", "description")
# -------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and outer dots; empty when the text has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.btrim(F.lower(authority), F.lit("."))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains, so domain matching is an equality."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def drop_blocked(items: DataFrame, domains: DataFrame) -> DataFrame:
    """Items whose host neither equals nor lies below a blocked domain (domain)."""
    clean = domains.select(F.btrim(F.lower(S.strip("domain")), F.lit(".")).alias("_d")).filter("_d <> ''").distinct()
    hosts = items.select(host_of(F.col("url")).alias("_h")).distinct()
    blocked = hosts.select("_h", F.explode(host_suffixes(F.col("_h"))).alias("_d")).join(clean, "_d", "left_semi").select("_h").distinct()
    return items.withColumn("_h", host_of(F.col("url"))).join(blocked, "_h", "left_anti").drop("_h")


def query_echo(description: Column, title: Column, query: Column) -> Column:
    """A short description whose title repeats nearly all query tokens."""
    short = F.length(S.strip(F.coalesce(description, F.lit("")))) < ECHO_MAX_CHARS
    q, t = S.token_set(F.coalesce(query, F.lit(""))), S.token_set(F.coalesce(title, F.lit("")))
    overlap = F.size(F.array_intersect(q, t)) / F.size(q)
    return short & (F.size(q) > 0) & (F.size(t) > 0) & F.coalesce(F.when(F.size(q) > 0, overlap >= ECHO_OVERLAP), F.lit(False))


def result_items(responses: DataFrame) -> DataFrame:
    """Raw responses (request_id, response JSON) to items: ``return`` or ``results``, objects only."""
    v = F.try_parse_json("response")
    df = responses.withColumn("_v", v)
    items = F.coalesce(V.at("_v", "$.return"), V.at("_v", "$.results"), F.col("_v")).try_cast("array<variant>")
    out = df.select(*[c for c in responses.columns if c != "response"], F.posexplode(items).alias("pos", "_i")).filter(V.is_object("_i"))
    return out.withColumns(
        {
            "title": V.text_at("_i", "$.title"),
            "url": V.text_at("_i", "$.url"),
            "description": F.coalesce(V.text_at("_i", "$.description"), V.text_at("_i", "$.snippet")),
        }
    ).drop("_i")


def first_results(items: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first n items per request; the rank filter also runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(n, 1))


def shaped(items: DataFrame, requests: DataFrame, domains: DataFrame, n: int) -> DataFrame:
    """Filtered first results per request and its status; a request without results is NO_RESULT.

    items: request_id, pos, title, url, description; requests: request_id, query.
    """
    kept = drop_blocked(items, domains).join(requests, "request_id")
    kept = kept.filter(~query_echo(F.col("description"), F.col("title"), F.col("query")))
    top = first_results(kept, n, ["request_id"], ["pos"]).drop("query")
    out = requests.select("request_id").join(top, "request_id", "left")
    return out.withColumn("status", F.when(F.col("rank").isNull(), F.lit("NO_RESULT")).otherwise(F.lit("SUCCESS")))
