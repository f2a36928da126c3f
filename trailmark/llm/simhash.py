"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits, bit b being 1 if it is set in over half of the hashes of a text's word
shingles (repeats count). Two fingerprints are linked if at most ``radius`` bits differ.

The 64 bits form a ring of ``segments`` parts. By the pigeonring principle a pair within the radius
has a start segment from which every chain of k consecutive segments differs in at most
floor(k * radius / segments) bits. The chains whose budget is zero must be equal, so they are the
join key (two of five segments, about 26 bits, for the defaults); the longer chains prune the
candidates, and only what is left gets the full Hamming check.

Keys shared by more fingerprints than ``pair_limit`` are not paired. Within such a group each
fingerprint meets all points that are at most radius / 2 bit flips away from it: two fingerprints
are within the radius exactly if they have such a point in common, so linking each to the least one
at every point gives the same components with a number of rows that grows with the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import components, staged

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number; zero if the text has no word.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than
    a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    width = min(shingle, len(words))
    count = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    step = 1 << 16
    for at in range(0, count, step):
        to = min(at + step, count)
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:to], ends[at + width - 1 : to + width - 1])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Add the fingerprint as a signed long; a null text counts as empty. Whole texts are read."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(segments: int) -> list[int]:
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _by_ring(values: list[int]) -> Column:
    """The value of a row's start segment."""
    return F.element_at(F.array(*[F.lit(_signed(v)) for v in values]), F.col("ring") + 1)


def near_pairs(fps: DataFrame, fp: str = "fp", radius: int = 2, segments: int = 5, pair_limit: int = 64) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that have the components of all pairs within ``radius``.

    Pairs under keys of up to ``pair_limit`` fingerprints are all returned; under a larger key the
    links are a subset with the same components (see the module). Null fingerprints take no part.
    """
    if radius % 2 or segments <= radius:
        raise ValueError("the radius must be even and below the number of segments")
    parts = _masks(segments)
    budget = [k * radius // segments for k in range(segments + 1)]
    equal = max(k for k in range(segments + 1) if budget[k] == 0)

    def chain(k: int) -> list[int]:
        return [sum(parts[(i + j) % segments] for j in range(k)) for i in range(segments)]

    own = fps.filter(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct()
    rings = F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(chain(equal))])
    keys = own.select("fp", F.explode(rings).alias("r")).select("fp", "r.ring", "r.key")
    sizes = keys.groupBy("ring", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(keys.join(sizes, ["ring", "key"]), "rings")

    few = met.filter(F.col("n") <= pair_limit)
    left = few.select("ring", "key", F.col("fp").alias("a"))
    right = few.select("ring", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tests = [F.bit_count(differ.bitwiseAND(_by_ring(chain(k)))) <= budget[k] for k in range(equal + 1, segments)]
    pairs = left.join(right, ["ring", "key"]).filter("a < b")
    for test in [*tests, F.bit_count(differ) <= radius]:
        pairs = pairs.filter(test)

    flips = [[m for k in range(radius // 2 + 1) for m in _flips(free, k)] for free in (((1 << BITS) - 1) ^ c for c in chain(equal))]
    most = max(map(len, flips))
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in (row + [0] * (most - len(row)))]) for row in flips])
    points = (
        met.filter(F.col("n") > pair_limit)
        .select("ring", "fp", F.explode(F.element_at(table, F.col("ring") + 1)).alias("flip"))
        .select("ring", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    shared = points.groupBy("ring", "point").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    starred = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return pairs.select("a", "b").union(starred).distinct()


def _flips(free: int, k: int) -> list[int]:
    places = [1 << i for i in range(BITS) if free >> i & 1]
    return [sum(c) for c in combinations(places, k)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 2, segments: int = 5, pair_limit: int = 64) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest id reachable over links. A null text counts as empty and has the
    fingerprint zero, which links like any other; a null id is kept, takes part in linking and is
    never a component id unless its whole component has null ids. Repeated rows give repeated
    rows. Other columns are neither read nor returned. An empty table gives an empty table.
    """
    marked = staged(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "simhash")
    classes, parts = _components(marked, radius, segments, pair_limit)
    named = classes.join(parts, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = named.join(least, "component").select("fp", "component_id")
    return marked.join(whole, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame, radius: int = 2, segments: int = 5, pair_limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints of ``marked`` (id, fp) with the least id (fp, first), and with their component (fp, component)."""
    classes = staged(marked.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    linked = components(near_pairs(classes, radius=radius, segments=segments, pair_limit=pair_limit))
    return classes, classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows without near duplicates: of each component one row stays, the first by id (nulls last) and row number.

    Ids only order the rows: those that repeat an id or have none are compared and kept like any other.
    """
    numbered = staged(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("rid")), "numbered")
    texts = numbered.select("rid", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text}`").alias("text"))
    marked = staged(with_fingerprint(texts).select("rid", "id", "fp"), "simhash")
    _, parts = _components(marked, **options)
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "rid")
    first = marked.join(parts, "fp").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("rid"))
    return numbered.join(first, "rid", "left_semi").select("doc.*")


__all__ = ["fingerprint", "keep_one_row", "near_duplicates", "near_pairs", "with_fingerprint"]
