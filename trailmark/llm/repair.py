"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over checkpoints.

A row can be kept, given another role, deleted, or rows can be inserted before it; the final role initials must be
``(s?(ua)+)?``. Four states say what may come next (start, after s, after u, after a), so the least cost from a row on
is a vector of four numbers. Of equally cheap edits the audit that is least in ASCII order (D < I < K < R) is taken: at
each step of a forward walk the first edit whose cost is tight with the vector behind it.

The vectors are kept at every square root of a block's length only; walking forward, each stretch between two
checkpoints is computed again. A long conversation is a chain of blocks of at most ``BLOCK`` rows, cut from one global
range sort, so no key gathers: a block gives the matrix of its least costs from state to state, matrices are combined
from the end for the vector behind each block, then blocks are walked from all four states and chained from the start.
Only one summary per block meets in a task.

Finally rows and the edits of their blocks stream in order through one task per conversation, which hashes and forgets
them (a SHA-256 has no parallel form); nothing but the audit grows there.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from trailmark.llm.common import staged, unstage

#: Rows of a block; a power of two.
BLOCK = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: 0, ASSISTANT: 0}
FAR = 1 << 40
#: What an inserted or rerolled row becomes in a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Marks of rows: blank, duplicate, else the role initial (x: no useful one), in capitals where truncated.
BLANK, DUPLICATE = "b", "d"


# the rows


def damage(rows: DataFrame) -> DataFrame:
    """Damage (conv_id, turn, role, text) by crc32 of ``conv_id:turn``: drop, empty, take stops, repeat, set role user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _mark(role: Column, text: Column) -> Column:
    """The mark of a row that is no duplicate."""
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")
    end = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return F.when(end == "", BLANK).when(end.isin(*STOPS), initial).otherwise(F.upper(initial))


def ordered(rows: DataFrame) -> DataFrame:
    """Written rows (conv_id, turn, role, digest of the text, seq, mark) in order, texts left behind.

    The order is conv_id, turn (nulls first), role, digest; rows equal in all of these are the same. ``seq`` counts rows
    of the sorted ranges, so ``seq`` in units of ``BLOCK`` cuts every conversation into blocks, whatever its turns are.
    """
    light = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), _mark(F.col("role"), F.col("text")).alias("mark"), F.monotonically_increasing_id().alias("_salt"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = light.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    seen = staged(ranged.select(*order, "mark", F.monotonically_increasing_id().alias("seq")), "turns")
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    mark = F.when(F.col("mark") == BLANK, BLANK).when(F.col("_first").isNull(), DUPLICATE).otherwise(F.col("mark"))
    marked = staged(seen.join(first, "seq", "left").select(*order, "seq", mark.alias("mark")), "marks")
    unstage(seen)
    return marked


def blocks(marked: DataFrame) -> DataFrame:
    """One row per block: conversation, block, its first row's place in the order, its marks, blocks of the conversation."""
    key = F.floor(F.col("seq") / BLOCK).alias("blk")
    inner = marked.groupBy("conv_id", key).agg(
        F.min_by(F.struct("turn", "role", "digest"), "seq").alias("head"),
        F.array_sort(F.collect_list(F.struct("seq", "mark"))).alias("rows"),
    )
    written = staged(inner.select("conv_id", "blk", "head.*", F.array_join("rows.mark", "").alias("marks")), "blocks")
    many = written.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1")
    long_ = many.select(F.col("conv_id").alias("_c"), "n")
    return written.join(long_, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")


# the program


@lru_cache(maxsize=1 << 16)
def _before(after: tuple[int, ...], mark: str) -> tuple[int, ...]:
    """Least costs from before a row on, by state."""
    bare = [min(cost + after[to] for _, cost, to in _own(state, mark)) for state in range(4)]
    return _with_inserts(bare)


def _with_inserts(bare: list[int]) -> tuple[int, ...]:
    user, answer = min(bare[USER], INSERT + bare[ASSISTANT]), min(bare[ASSISTANT], INSERT + bare[USER])
    return min(bare[START], INSERT + user), min(bare[SYSTEM], INSERT + user), user, answer


@lru_cache(maxsize=None)
def _own(state: int, mark: str) -> tuple[tuple[str, int, int], ...]:
    """Edits of a row itself in ASCII order of their names: (code, cost, next state)."""
    edits = [("D", DELETE, state)]
    if mark not in (BLANK, DUPLICATE):
        more, initial = (TRUNCATED if mark.isupper() else 0), mark.lower()
        if (state, initial) in KEPT:
            edits.append(("K", more, KEPT[state, initial]))
        edits.append(("U" if NEXT[state] == USER else "A", more + REROLE, NEXT[state]))
    return tuple(edits)


#: Least costs behind a conversation's last row.
END = _with_inserts([0, FAR, FAR, 0])


def _less(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """A vector with its least number taken off, so that few different ones occur, and that number."""
    low = min(vector)
    return tuple(v - low for v in vector), low


def _backward(marks: str, vector: tuple[int, ...]) -> tuple[int, ...]:
    total = 0
    for mark in reversed(marks):
        vector, low = _less(_before(vector, mark))
        total += low
    return tuple(v + total for v in vector)


def _checkpoints(marks: str, end: tuple[int, ...]) -> tuple[int, list[tuple[int, ...]]]:
    """The stretch length and the vectors behind each stretch, less their least numbers (edits need differences alone)."""
    step = max(1, math.isqrt(len(marks)))
    kept = [_less(end)[0]]
    for at in range((len(marks) - 1) // step * step, 0, -step):
        kept.append(_less(_backward(marks[at : at + step], kept[-1]))[0])
    return step, kept[::-1]


def walk(marks: str, end: tuple[int, ...], state: int, last: bool = True) -> tuple[str, int]:
    """Codes of the cheapest edits of a block, and the state behind it.

    Per row ``u``/``a`` for each inserted user or assistant row before it, then D, K, or U/A for a new role; behind the
    last row of the conversation come the inserts that end it. ``end`` is the vector behind the block.
    """
    codes: list[str] = []
    if marks:
        step, kept = _checkpoints(marks, end)
        for number, behind in enumerate(kept):
            part = marks[number * step : (number + 1) * step]
            vectors = [behind]
            for mark in reversed(part):
                vectors.append(_less(_before(vectors[-1], mark))[0])
            for i, mark in enumerate(part, 1):
                state = _edit(codes, mark, vectors[len(part) - i], state)
    while last and state not in ENDS:
        codes.append("u" if NEXT[state] == USER else "a")
        state = NEXT[state]
    return "".join(codes), state


def _edit(codes: list[str], mark: str, after: tuple[int, ...], state: int) -> int:
    """Append the edits of one row, first tight ones in order D, I, K, R."""
    while True:
        best = _before(after, mark)[state]
        options = [(code, cost + after[to], to) for code, cost, to in _own(state, mark)]
        into = NEXT[state]
        options.insert(1, ("u" if into == USER else "a", INSERT + _before(after, mark)[into], into))
        code, _, state = next(o for o in options if o[1] == best)
        codes.append(code)
        if code in "DKUA":
            return state


def cost_of(codes: str, marks: str) -> int:
    """Cost of codes over the rows they were made for."""
    total = sum({"D": DELETE, "U": REROLE, "A": REROLE, "u": INSERT, "a": INSERT}.get(c, 0) for c in codes)
    return total + TRUNCATED * sum(c != "D" and m.isupper() for c, m in zip((c for c in codes if c in "DKUA"), marks))


AUDIT = str.maketrans("uaUA", "IIRR")


# the blocks of long conversations


@F.pandas_udf(ArrayType(LongType()))
def _matrix(marks: pd.Series) -> pd.Series:
    """Least costs of a block from state to state, row by row of the first state."""
    def one(text: str) -> list[int]:
        columns = [_backward(text, tuple(0 if s == to else FAR for s in range(4))) for to in range(4)]
        return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]

    return marks.map(one)


@F.pandas_udf(ArrayType(StructType().add("blk", LongType()).add("behind", ArrayType(LongType()))))
def _behind(matrices: pd.Series) -> pd.Series:
    """The vectors behind each block of a conversation, from its blocks' matrices in order."""
    def one(rows: list) -> list[dict]:
        vector, found = END, []
        for row in reversed(list(rows)):
            found.append({"blk": row["blk"], "behind": list(vector)})
            m = row["matrix"]
            vector = _less(tuple(min(int(m[4 * s + to]) + vector[to] for to in range(4)) for s in range(4)))[0]
        return found

    return matrices.map(one)


@F.pandas_udf(ArrayType(IntegerType()))
def _exits(marks: pd.Series, behind: pd.Series) -> pd.Series:
    """The states behind a block, by the state before it."""
    return pd.Series([[walk(m, tuple(int(v) for v in b), s, False)[1] for s in range(4)] for m, b in zip(marks, behind)])


@F.pandas_udf(ArrayType(StructType().add("blk", LongType()).add("entry", IntegerType())))
def _entries(exits: pd.Series) -> pd.Series:
    """The state before each block of a conversation, from its blocks' exits in order."""
    def one(rows: list) -> list[dict]:
        state, found = START, []
        for row in rows:
            found.append({"blk": row["blk"], "entry": state})
            state = int(row["exits"][state])
        return found

    return exits.map(one)


@F.pandas_udf(BinaryType())
def _codes(marks: pd.Series, behind: pd.Series, entry: pd.Series, last: pd.Series) -> pd.Series:
    """Packed codes and marks of a block."""
    out = []
    for m, b, e, z in zip(marks, behind, entry, last):
        out.append(zlib.compress(f"{walk(m, tuple(int(v) for v in b), int(e), bool(z))[0]}\n{m}".encode(), 1))
    return pd.Series(out)


def _chained(each: DataFrame, value: str, chain, given: str) -> DataFrame:
    """Per block what ``chain`` makes of one small value per block of its conversation, in order."""
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("blk", value))).alias("_all"))
    return whole.select(F.col("conv_id").alias("_c"), F.explode(chain("_all")).alias("_one")).select("_c", F.col("_one.blk").alias("_blk"), f"_one.{given}")


def solved(cut: DataFrame) -> DataFrame:
    """Blocks with the packed codes of their edits, in place of their marks."""
    end = F.array(*[F.lit(v).cast("bigint") for v in END])
    short = cut.filter("n is null").select("*", end.alias("behind"), F.lit(START).alias("entry"), F.lit(True).alias("last"))
    long_ = staged(cut.filter("n is not null").withColumn("matrix", _matrix("marks")), "long-blocks")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("blk") == F.col("_blk"))
    back = staged(long_.join(_chained(long_, "matrix", _behind, "behind"), same).drop("_c", "_blk", "matrix").withColumn("exits", _exits("marks", "behind")), "walked")
    into = back.join(_chained(back, "exits", _entries, "entry"), same).drop("_c", "_blk", "exits")
    final = back.groupBy(F.col("conv_id").alias("_c")).agg(F.max("blk").alias("_blk"))
    closed = into.join(final, F.col("conv_id").eqNullSafe(F.col("_c")), "left").withColumn("last", F.col("blk") == F.col("_blk")).drop("_c", "_blk")
    both = short.unionByName(closed)
    return both.select("conv_id", "blk", "turn", "role", "digest", _codes("marks", "behind", "entry", "last").alias("codes"))


# the digests


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.first, self.last = conv_id, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.written, self.initial = hashlib.sha256(), False, None
        self.queue: deque[bytes] = deque()
        self.codes, self.marks, self.at, self.row = "", "", 0, 0

    def _open(self) -> None:
        """Take the next block's edits once all of the present ones are done."""
        self._rest()
        self.codes, self.marks = zlib.decompress(self.queue.popleft()).decode().split("\n")
        self.at = self.row = 0
        self.cost += cost_of(self.codes, self.marks)
        self.audit.append(self.codes.translate(AUDIT))

    def _rest(self) -> None:
        for code in self.codes[self.at :]:
            self._insert(code)

    def _insert(self, code: str) -> None:
        self._put("user:" if code == "u" else "assistant:")

    def _put(self, piece: str) -> None:
        self.hash.update((("\n" if self.written else "") + piece).encode())
        self.written = True

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = (turn if self.first is None else self.first), turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if self.row == len(self.marks):
            self._open()
        mark = self.marks[self.row]
        self.row += 1
        self.blank += mark == BLANK
        self.duplicate += mark == DUPLICATE
        self.truncated += mark.isupper()
        while self.codes[self.at].islower():
            self._insert(self.codes[self.at])
            self.at += 1
        code = self.codes[self.at]
        self.at += 1
        if code != "D":
            self._put(f"{ {'U': 'user', 'A': 'assistant'}.get(code, role) }:{text}")

    def digest(self) -> dict:
        self._rest()
        gaps = min(self.last - self.first + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256().hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from rows in order, each block's edits ahead of its rows."""
    names = DIGEST.replace(" bigint", "").replace(" string", "").split(", ")
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    now: _Conversation | None = None
    done: list[dict] = []
    size = 0
    for batch in batches:
        for conv, turn, role, text, codes in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "codes")]):
            if now is None or conv != now.conv_id:
                if now is not None:
                    done.append(now.digest())
                    size += len(done[-1]["audit"]) + 200
                now = _Conversation(conv)
            if codes is not None:
                now.queue.append(codes)
            else:
                now.add(turn, role, text)
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(done, schema)
            done, size = [], 0
    if now is not None:
        done.append(now.digest())
    yield pa.RecordBatch.from_pylist(done, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """One digest per conversation of a table (conv_id, turn, role, text) taken as it is, as in ``DIGEST``.

    Rows are taken by turn, null turns first, then by role and the SHA-256 of the text; null roles and texts are one space;
    rows with a null conv_id are one conversation. A row's first fault counts: blank, duplicate (its role and text came
    earlier), truncated (it doesn't end in a stop). A role that starts with none of s, u, a can't be kept. ``gaps`` beyond a
    long are the largest long. Other columns are not read; an empty table gives no rows.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"))
    found = solved(blocks(ordered(rows)))
    both = rows.select("*", F.sha2("text", 256).alias("digest"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("blk"), F.lit(None).cast("binary").alias("codes")).unionByName(
        found.select("conv_id", "turn", "role", "digest", "blk", "codes", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("text"))
    )
    lined = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "_kind", "blk")
    return lined.select("conv_id", "turn", "role", "text", "codes").mapInArrow(_streamed, DIGEST)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations after ``damage``; one that loses all rows has zeros, no audit and the empty hash."""
    digests = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    ids = every.select(F.col("conv_id").alias("_c"))
    gone = ids.join(damage(conversations).select("conv_id").distinct(), F.col("_c").eqNullSafe(F.col("conv_id")), "left_anti")
    zeros = [F.lit(0).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return digests.unionByName(gone.select(F.col("_c").alias("conv_id"), *zeros, F.lit("").alias("audit"), F.lit(_EMPTY).alias("repaired_sha256")))
