"""URL filters: path rules first, then host reputation by empirical Bayes.

A labelled page is an outcome of its host: good or bad. Rates are shrunk down a tree: all hosts -> suffix -> registered
domain -> host. At each level the children's rates are beta-binomial around their parent's posterior mean, and the
strength of that prior is estimated from the children themselves by moments (the spread of their counts beyond a
binomial's). A host is blocked if the lower bound of its posterior rate of bad pages, mean - z * sd of its beta
posterior, is above the limit; hosts without outcomes inherit their domain's posterior mean and its uncertainty.

Everything is DataFrame code: outcomes are counted per (page, host) and per host before any join, so one host or page id
with a third of all rows sends a row per task. The reputation table has a row per host. Frequent hosts (at most
``1 / HOT_SHARE`` of them can exist) meet their pages by a broadcast, the others by a shuffle that has no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import SEND_ROWS, held_out, staged

#: A host with a larger share of the pages than this counts as frequent.
HOT_SHARE = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of more than one label; a caller can pass a longer list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx", "co.kr")


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """The text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as for ``host_of``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule (host and path as text; of equals the first given) that fits, as (rule, verdict); null if none."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def suffix_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of a host: one of the given or the last label; empty for addresses of digits and for an empty host."""
    two = F.substring_index(name, ".", -2)
    own = F.when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))
    return F.when(name.rlike(r"^[0-9.]*$|:"), F.lit("")).otherwise(own)


def places(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Add suffix and registered domain (one label more than the suffix) to a table with a host; user and port don't count."""
    name = F.regexp_replace(F.regexp_replace(F.col("host"), r"^.*@|:[0-9]*$", ""), r"\.$", "")
    named = hosts.withColumn("_name", name).withColumn("suffix", suffix_of(F.col("_name"), suffixes))
    labels = F.size(F.split("suffix", r"\.")) + 1
    domain = F.when(F.col("suffix") == "", F.col("_name")).otherwise(F.array_join(F.slice(F.reverse(F.split("_name", r"\.")), 1, labels), "\n"))
    return named.withColumn("domain", F.array_join(F.reverse(F.split(domain, "\n")), ".")).drop("_name")


def outcomes(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Counts per host (host, pages, n labelled, bad): a labelled page is bad if it is toxic or of low quality.

    Labels of held-out ids aren't learned; an id with several labels is bad if one of them says so, and null in both
    marks is no label. Pages that repeat an id count each; null ids have no label, null urls have the empty host.
    """
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host")).groupBy("id", "host").agg(F.count("*").alias("pages"))
    bad = F.greatest(F.col("toxic") == 1, F.col("quality") == 0).cast("int")
    known = labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), bad.alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    learned = seen.join(known, "id", "left")
    n = F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)
    return learned.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum(n).alias("n"), F.sum(n * F.coalesce("bad", F.lit(0))).alias("bad"))


def strength(children: DataFrame, mean: Column) -> float:
    """Prior size of beta-binomial children (n, bad) around a mean each, by moments of their counts.

    With intraclass correlation r, a child's squared deviation has the expectation n m (1-m) (1 + (n-1) r); r is solved
    from the sums over all children and kept within [0.0001, 0.5]; without a child of two outcomes it is 0.5.
    """
    v = mean * (1 - mean)
    n = F.col("n").cast("double")
    got = children.agg(F.sum((F.col("bad") - n * mean) ** 2 - n * v).alias("over"), F.sum(n * (n - 1) * v).alias("by")).first()
    r = got["over"] / got["by"] if got["by"] else 0.5
    r = min(max(r, 1e-4), 0.5)
    return 1 / r - 1


def reputation(hosts: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior per host (host, weight in pages, rate, bound) from a counted table as of ``outcomes``.

    Without any outcome the overall rate is a half. ``bound`` is rate - z * sd of the host's beta posterior, not below 0.
    """
    named = staged(places(hosts, suffixes), "hosts")
    total = named.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = (total["bad"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    keys: list[str] = []
    for level in ("suffix", "domain", "host"):
        inner = [*keys, level]
        counted = named.groupBy(*inner).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages"), F.count("*").alias("hosts"))
        under = meet(counted, up.select(*keys, "mean", F.col("hosts").alias("weight")), keys) if keys else counted.withColumn("mean", F.lit(rate))
        under = staged(under, f"reputation-{level}")
        prior = strength(under, F.col("mean"))
        size = F.col("n") + F.lit(prior)
        up = staged(under.select(*inner, "pages", "hosts", ((F.col("bad") + F.lit(prior) * F.col("mean")) / size).alias("mean"), size.alias("size")), "posterior")
        keys = inner
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return up.select("host", F.col("pages").alias("weight"), F.col("mean").alias("rate"), F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("bound"))


def meet(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows with a written table that has one row per key and the key's ``weight`` in rows.

    A table that has been counted to be small is sent whole. Of a larger one only the keys with a large share of all rows
    are sent, whose number the share bounds, and the rest meets in a shuffle that has no hot key.
    """
    row = known.agg(F.sum("weight").alias("rows"), F.count("*").alias("n")).first()
    if row["n"] <= SEND_ROWS:
        return rows.join(F.broadcast(known.drop("weight")), [*keys])
    frequent = F.col("weight") > row["rows"] * HOT_SHARE
    added = [c for c in known.columns if c not in (*keys, "weight")]
    hot = known.filter(frequent).select(*keys, F.struct(*added).alias("_hot"))
    met = rows.join(F.broadcast(hot), [*keys], "left")
    done = met.filter("_hot is not null").select(*rows.columns, "_hot.*")
    rest = met.filter("_hot is null").drop("_hot").join(known.filter(~frequent).drop("weight").hint("shuffle_merge"), [*keys])
    return done.unionByName(rest)


def judge(
    pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES,
    limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, rate and bound.

    The longest fitting rule decides; without one a page is blocked if its host's bound is above ``limit``. Null urls and
    urls without ``://`` have an empty host and path; the empty host has a reputation like any other. Rows that repeat are
    judged each; other columns are not read, an empty table gives no rows.
    """
    known = reputation(outcomes(pages, labels, id_col=id_col, url=url), z, suffixes)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = meet(parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)), staged(known, "reputation"), ["host"])
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), "rate", "bound")
