"""Vector code compression: product codes whose codebooks are fitted with adaptive distance bounds.

A vector's components become integers floor(scale * x). It is cut into equal parts, and each part position has a
codebook of up to ``entries`` integer entries. Fitting alternates assignment and floored means; a part goes to the
entry with the least squared distance, of equals to the lower index. All distances that decide are exact integers.

Between assignments each part keeps, in a written table, its b closest entries with lower bounds of their distances,
nearest first, and one outer bound below the distances of all others. When entries have moved, the bounds give way by
the entries' movements: a part whose own exact distance is below all its bounds stays without another distance; else
the listed entries are measured, and only where the outer bound is reached are all. How many list places were reached
decides b of the batch's next lists, so lists shrink where entries settle. Bounds are rounded down to 16-bit floats.

Rows are independent tasks over Arrow batches; per round the tasks send sums per (part, entry), which are added in
Spark, and the driver holds the codebooks alone (parts x entries x width numbers). Lost executors repeat tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import send_if_small, staged, unstage
from trailmark.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, NEAR, SCALE = 16, 64, 2, 8, 256
#: Rows whose distances to all entries are held at once.
CHUNK = 4_096
#: Integer components from here on are refused: errors of such vectors don't fit a long.
LARGEST = 1 << 60


def integers(df: DataFrame, id_col: str, vector: str, label: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, x as integers) that take part, and the dimension.

    Vectors that are null, empty or hold null or non-finite components take no part; null and repeated ids do. Vectors
    must have one length: the most frequent one counts (of equals the smaller). Components of 2**60 and more after
    scaling raise an error.
    """
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).alias("label"), value.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    top = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not top:
        return rows.select("vec_id", "label", F.transform("v", lambda x: F.lit(0).cast("bigint")).alias("x")), 0
    if top[0]["top"] >= LARGEST / scale:
        raise ValueError("a component is too large for exact distances")
    rows = rows.filter(F.size("v") == top[0]["d"])
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("x")), top[0]["d"]


class Books:
    """The codebooks of one round (part x entry x width) and how far each entry moved since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(entries.shape[:2])
        if before is not None:
            self.moved = _above(np.sqrt(((entries - before) ** 2).sum(-1).astype(float)))

    def cut(self, column: pa.Array, size: int) -> np.ndarray:
        """Vectors as rows x part x width; a length that the parts don't divide is filled with zeros."""
        parts, _, width = self.entries.shape
        x = matrix(column, size)
        if parts * width > size:
            x = np.pad(x, ((0, 0), (0, parts * width - size)))
        x = x.reshape(-1, parts, width)
        return x.astype(object) if self.entries.dtype == object else x

    def distances(self, x: np.ndarray, part: int, chosen: np.ndarray | None = None) -> np.ndarray:
        """Exact squared distances of parts (rows x width) to all entries, or to the chosen ones (rows x any)."""
        to = self.entries[part][None] if chosen is None else self.entries[part][chosen]
        return ((x[:, None, :] - to) ** 2).sum(-1)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 1e-12), np.inf)


def _below(squared: np.ndarray) -> np.ndarray:
    """A lower bound of a distance from its exact square."""
    return np.sqrt(squared.astype(float)) * (1 - 1e-12)


def _half(x: np.ndarray) -> np.ndarray:
    """Bounds as 16-bit floats, rounded down."""
    low = np.minimum(np.maximum(x, 0), 65504.0).astype(np.float16)
    return np.where(low.astype(float) > x, np.nextafter(low, np.float16(-1)), low).clip(0)


def first_lists(books: Books, x: np.ndarray, part: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closest entries of parts in order, exact squared distance of the first, lower bounds and the outer bound."""
    far = books.distances(x, part)
    order = np.argsort(far, axis=1, kind="stable")[:, : near + 1]
    there = np.take_along_axis(far, order, 1)
    bounds = _below(there)
    outer = bounds[:, near] if order.shape[1] > near else np.full(len(x), np.inf)
    return order[:, :near].astype(np.uint8), there[:, 0], bounds[:, :near], outer


def next_lists(books: Books, x: np.ndarray, part: int, ids: np.ndarray, low: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Lists after the entries have moved; also how many list places were reached and how many rows measured all entries."""
    ids, near = ids.copy(), ids.shape[1]
    low = np.maximum(low - books.moved[part][ids], 0)
    outer = np.maximum(outer - books.moved[part].max(initial=0), 0)
    own = books.distances(x, part, ids[:, :1])[:, 0]
    reach = _above(np.sqrt(own.astype(float)))
    reached = (low[:, 1:] <= reach[:, None]).sum(1)
    low[:, 0] = _below(own)
    open_ = np.flatnonzero((reached > 0) | (outer <= reach))
    if open_.size:
        there = books.distances(x[open_], part, ids[open_])
        order = np.lexsort((ids[open_], there), axis=1) if there.dtype != object else np.array([sorted(range(near), key=lambda j: (d[j], i[j])) for d, i in zip(there, ids[open_])])
        ids[open_], there = np.take_along_axis(ids[open_], order, 1), np.take_along_axis(there, order, 1)
        low[open_], own[open_] = _below(there), there[:, 0]
    rest = np.flatnonzero(outer <= _above(np.sqrt(own.astype(float))))
    if rest.size:
        ids[rest], own[rest], low[rest], outer[rest] = first_lists(books, x[rest], part, near)
    order = np.argsort(low[:, 1:], axis=1, kind="stable") + 1
    ids[:, 1:], low[:, 1:] = np.take_along_axis(ids, order, 1), np.take_along_axis(low, order, 1)
    settled = np.ones(len(x), bool)
    settled[rest] = False
    return ids, own, low, outer, int(reached[settled].max(initial=0)), int(rest.size)


def packed(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Lists of all parts as one row of bytes per vector: the b of each part, then ids, bounds and outer bound."""
    n = len(lists[0][0])
    pieces = [np.tile(np.array([ids.shape[1] for ids, _, _ in lists], np.uint8), (n, 1))]
    for ids, low, outer in lists:
        pieces += [ids, _half(low).view(np.uint8).reshape(n, -1), _half(outer[:, None]).view(np.uint8).reshape(n, -1)]
    return np.ascontiguousarray(np.concatenate(pieces, axis=1))


def unpacked(rows: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, lists = parts, []
    for near in rows[0, :parts].astype(int):
        ids = rows[:, at : at + near]
        low = np.ascontiguousarray(rows[:, at + near : at + 3 * near]).view(np.float16).astype(float)
        outer = np.ascontiguousarray(rows[:, at + 3 * near : at + 3 * near + 2]).view(np.float16).astype(float)[:, 0]
        lists.append((ids, low, outer))
        at += 3 * near + 2
    return lists


def _bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _alike(states: pa.Array, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and byte rows of lists of one layout."""
    rows = [np.frombuffer(s, np.uint8) for s in states.to_pylist()]
    groups: dict[bytes, list[int]] = {}
    for i, row in enumerate(rows):
        groups.setdefault(row[:parts].tobytes(), []).append(i)
    for found in groups.values():
        yield np.array(found), np.stack([rows[i] for i in found])


def assign(rows: DataFrame, books: Books, size: int, near: int, *, again: bool, last: bool) -> DataFrame:
    """Add to (vec_id, label, x) the code (bytes), the error and, unless it is the last time, the lists."""
    parts = books.entries.shape[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                x = books.cut(batch.column("x"), size)
                groups = _alike(batch.column("state"), parts) if again else [(np.arange(len(x)), None)]
                for at, states in groups:
                    lists, codes, error = [], np.empty((len(at), parts), np.uint8), np.zeros(len(at), books.entries.dtype)
                    old = unpacked(states, parts) if again else None
                    for part in range(parts):
                        mine = x[at, part]
                        if again:
                            ids, own, low, outer, reached, _ = next_lists(books, mine, part, *old[part])
                            keep = min(ids.shape[1], max(2, reached + 1))
                            outer = np.minimum(outer, low[:, keep:].min(1, initial=np.inf))
                            ids, low = ids[:, :keep], low[:, :keep]
                        else:
                            ids, own, low, outer = first_lists(books, mine, part, near)
                        codes[:, part] = ids[:, 0]
                        error += own
                        lists.append((ids, low, outer))
                    if error.dtype == object and max(error, default=0) >= 1 << 63:
                        raise OverflowError("a vector's error doesn't fit a long")
                    out = {"vec_id": batch.column("vec_id").take(pa.array(at)), "label": batch.column("label").take(pa.array(at))}
                    if not last:
                        out |= {"x": batch.column("x").take(pa.array(at)), "state": _bytes(packed(lists))}
                    out |= {"code": _bytes(codes), "error": pa.array(error.tolist(), pa.int64())}
                    yield pa.RecordBatch.from_pydict(out)

    label = rows.schema["label"].dataType.simpleString()
    kept = "" if last else "x array<bigint>, state binary, "
    return rows.mapInArrow(work, f"vec_id bigint, label {label}, {kept}code binary, error bigint")


def means(rows: DataFrame, books: Books, size: int) -> Books:
    """Codebooks whose entries are the floored means of their parts; unused entries stay."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = books.cut(batch.column("x"), size)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for part in range(parts):
                here = np.zeros((entries, width), x.dtype)
                np.add.at(here, codes[:, part], x[:, part])
                total[part] += here.astype(object)
                count[part] += np.bincount(codes[:, part], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.repeat(part, width)), "entry": pa.array(np.repeat(entry, width)), "place": pa.array(np.tile(np.arange(width), len(part))),
                "n": pa.array(np.repeat(count[part, entry], width)), "total": pa.array([str(t) for t in total[part, entry].reshape(-1)], pa.string()),
            }
        )

    sent = rows.select("x", "code").mapInArrow(sums, "part bigint, entry bigint, place bigint, n bigint, total string")
    added = sent.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = books.entries.copy()
    for r in added.collect():  # parts x entries x width rows at most
        after[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Books(after, books.entries)


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, near: int = NEAR) -> tuple[Books, DataFrame | None]:
    """Codebooks after some rounds, and the written rows with their lists (None without rounds). ``rows`` are written."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    width = -(-size // parts)
    seeds = [list(r["x"]) + [0] * (parts * width - size) for r in first]
    top = rows.select(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    exact = np.int64 if parts * width * (2 * top + 2) ** 2 < 1 << 62 else object
    books = Books(np.array(seeds, dtype=exact).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy())
    lists = None
    for turn in range(rounds):
        now = staged(assign(rows if lists is None else lists, books, size, min(near, len(first)), again=lists is not None, last=False), "lists")
        if lists is not None:
            unstage(lists)
        lists, books = now, means(now, books, size)
    return books, lists


def digest(books: Books) -> str:
    """Hash of all entries' components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.entries.reshape(-1)).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", *,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, near: int = NEAR, scale: int = SCALE,
) -> tuple[DataFrame, Books | None]:
    """Codes (vec_id, label, code as bytes, error) of all vectors that ``integers`` keeps, and the codebooks.

    Rows are kept one to one: null ids and repeated rows get codes too. Codebooks start with the vectors of the least
    ids (null ids last, equal ids in order of their vectors); fewer vectors than entries give fewer entries. Other
    columns are not read. An empty table gives no rows and no codebooks.
    """
    if not 0 < entries <= 256 or near < 1:
        raise ValueError("entries must be from 1 to 256, near at least 1")
    rows, size = integers(vectors, id_col, vector, label, scale)
    if not size:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0), None
    rows = staged(rows, "integers")
    books, lists = fit(rows, size, parts, entries, rounds, near)
    coded = staged(assign(lists or rows, books, size, min(near, books.entries.shape[1]), again=lists is not None, last=True), "codes")
    unstage(rows, *([lists] if lists is not None else []))
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the error summed over rows of equal label, nulls being equal; each label is summed before it meets the rows."""
    per = staged(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(send_if_small(per), F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
