"""Generated column expressions for the cells of many instances with different rules.

A rule names normalisations and metrics per column. Interpreting the names cell by cell (a lambda inside an array
function) keeps every step out of generated code and parses numbers and dates again for each comparison. Here the few
different rules of all instances are read once and written out as plain expressions, one per position; each cell is
normalised once and its number or date kept beside its text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S

#: Metrics that compare two cells without a model, by the bit that marks them in a mask.
BITS = {"exact_match": 1, "number_near": 2, "date_near": 4, "url_match": 8}
#: Different (position, normalisations) written out; beyond, chains are interpreted, with the same result.
WRITTEN_OUT = 1_000


@dataclass(frozen=True)
class CellPlan:
    """What occurs in the rules of all scorable instances."""

    width: int
    chains: tuple[tuple[str, ...], ...]
    #: positions at which each chain occurs
    chain_at: tuple[tuple[int, ...], ...]
    #: (position, metric) of cells that are compared natively
    spots: tuple[tuple[int, str], ...]

    @cached_property
    def written_out(self) -> bool:
        return sum(len(at) for at in self.chain_at) <= WRITTEN_OUT

    def positions(self, metric: str) -> list[int]:
        return [i for i, m in self.spots if m == metric]

    @cached_property
    def normalised(self) -> Column:
        """``vals`` after the normalisations of their columns; built once, as all parts of a plan are."""
        return _normalised(self)

    @cached_property
    def typed_vals(self) -> dict[str, Column]:
        return typed(self, "vals")

    def per_position(self, make, name: str = "n_required") -> Column:
        """An array with ``make(position)`` at each position of the row's instance."""
        return F.slice(F.array(*[make(i) for i in range(self.width)]), 1, F.greatest(F.col(name), F.lit(0)))


def cell_plan(ready: DataFrame) -> CellPlan:
    """The plan of instance status rows; what is collected is one row per different rule, not per instance."""
    cell = ready.select(F.posexplode("cols").alias("i", "c"))
    metric = F.when(~F.col("c.is_key"), F.col("c.metric"))
    rows = cell.groupBy("i", F.col("c.preprocess").alias("chain"), metric.alias("metric")).agg(F.count("*")).collect()
    at: dict[tuple[str, ...], set[int]] = {}
    spots = set()
    for r in rows:
        at.setdefault(tuple(r["chain"]), set()).add(r["i"])
        spots |= {(r["i"], m) for m in r["metric"] or () if m in BITS}
    chains = sorted(at)
    return CellPlan(max((r["i"] for r in rows), default=0) + 1, tuple(chains), tuple(tuple(sorted(at[c])) for c in chains), tuple(sorted(spots)))


def rules(ready: DataFrame, plan: CellPlan) -> DataFrame:
    """Per instance the numbers of its chains, the metric masks and the tolerances by position, and its key positions."""
    listed = F.array(*[F.array(*[F.lit(s) for s in c]).cast("array<string>") for c in plan.chains]) if plan.chains else F.array(F.array().cast("array<string>"))
    mask = lambda c: F.when(c["is_key"], F.lit(0)).otherwise(
        reduce(lambda a, b: a + b, [F.when(F.array_contains(c["metric"], m), F.lit(bit)).otherwise(F.lit(0)) for m, bit in BITS.items()])
    )
    return ready.select(
        "instance_id",
        "n_required",
        "key_idx",
        F.transform("cols", lambda c: F.array_position(listed, c["preprocess"])).alias("chain"),
        F.transform("cols", mask).alias("mask"),
        F.transform("cols", lambda c: c["criterion"]).alias("criterion"),
    )


def _normalised(plan: CellPlan, vals: str = "vals", chain: str = "chain") -> Column:
    """The cells after the normalisations of their columns."""
    if not plan.written_out:
        listed = F.array(*[F.array(*[F.lit(s) for s in c]).cast("array<string>") for c in plan.chains])
        return F.zip_with(vals, chain, lambda v, c: S.preprocess(v, F.get(listed, (c - 1).cast("int"))))

    def at(i: int) -> Column:
        out = cell = F.get(vals, F.lit(i))
        for number, (steps, where) in enumerate(zip(plan.chains, plan.chain_at), 1):
            if steps and i in where:
                value = reduce(lambda v, s: S.preprocess_step(v, F.lit(s)), steps, cell)
                out = F.when(F.get(chain, F.lit(i)) == number, value).otherwise(out)
        return out

    return plan.per_position(at)


def typed(plan: CellPlan, vals: Column | str, mask: str = "mask") -> dict[str, Column]:
    """Numbers and dates of the cells that are compared as such, null elsewhere."""

    def kind(metric: str, read, none: str):
        wanted = set(plan.positions(metric))
        cell = lambda i: F.get(vals, F.lit(i))
        return plan.per_position(lambda i: F.when(has(mask, i, metric), read(cell(i))) if i in wanted else F.lit(None).cast(none))

    return {"numbers": kind("number_near", S.number_or_percent, "double"), "days": kind("date_near", lambda c: F.unix_date(S.parse_date(c)), "int")}


def has(mask: str, i: int, metric: str) -> Column:
    return F.get(mask, F.lit(i)).bitwiseAND(F.lit(BITS[metric])) != 0


def agreement(plan: CellPlan, i: int, metric: str, left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether two cells agree; each side names its texts, numbers and days (the right one is the target)."""
    of = lambda name: F.get(name, F.lit(i))
    if metric == "exact_match":
        return F.lower(of(left[0])).eqNullSafe(F.lower(of(right[0])))
    if metric == "url_match":
        return S.url_hosts(of(left[0])) == S.url_hosts(of(right[0]))
    if metric == "number_near":
        return S.numbers_agree(of(left[1]), of(right[1]), of(left[0]), of(right[0]), of("criterion"))
    return S.days_agree(of(left[2]), of(right[2]))


RESPONSE, TARGET = ("response", "p_numbers", "p_days"), ("target", "g_numbers", "g_days")


def pair_columns(plan: CellPlan) -> dict[str, Column]:
    """Least and summed native score of a pair of rows; key columns score one each."""
    scores = [(i, F.when(has("mask", i, m), F.coalesce(agreement(plan, i, m, RESPONSE, TARGET), F.lit(False)).cast("double"))) for i, m in plan.spots]
    least = reduce(F.least, [F.coalesce(s, F.lit(1.0)) for _, s in scores], F.lit(1.0))
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for _, s in scores], F.size("key_idx").cast("double"))
    return {"row_score": least, "item_score": total}
