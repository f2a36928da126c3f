"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Bulk-synchronous best fit in descending order of length. Documents of one length are
interchangeable, and so are gaps of one size; both sides are therefore held run-length encoded as
ranges of ranks. A superstep takes the longest unplaced documents, finds the successor of their
length among the gaps (the smallest gap that holds them), gives the document of rank r in the run
the gap of rank r in the range, which resolves all conflicts at once, moves what is left of these
gaps to their new size, and repeats. The number of runs depends on the capacity and not on the
number of documents (`runs_bound`), so these sweeps touch a table of bounded size; everything that
grows with the input is distributed: the range sort that ranks documents within their length, and
the match of each rank with its gap.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import staged

#: Distinct words whose ids a worker keeps, and the longest word that is kept.
WORD_CACHE, LONGEST_CACHED = 700_000, 64
#: Documents of one length that are ranked in one task.
RANKED_TOGETHER = 20_000

#: Words that the tokenizer's normalization and splitting leave whole, and the letters that stand for their bytes in the model.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Of the bytes of such words and of the mark, those that the model shows as other letters than their own.
BYTE_LETTERS = (("\x01", "\u0101"), ("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
#: Marks that are parted from a word's end.
TAIL = b".,;:!?$%&*#|)"
#: Documents tokenized at a time.
ENCODED_TOGETHER = 512

PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECE_NAMES = ["id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


class WordEncoder:
    """Ids of whole texts by a tokenizer file, through a cache of words.

    The tokenizer separates tokens at white space and normalizes no character across it, so a
    text's ids are those of its blank-separated words, one after the other. New words are encoded
    together in one text, a control character standing between them; words that hold it are encoded alone.
    """

    MARK = b"\x01"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.MARK)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.plain = self._plain(path)

    def _plain(self, path: str):  # noqa: ANN202 - a Tokenizer or None
        """The model alone, for words of small Latin letters, which normalization and splitting leave as they are.

        None if the file is of another kind or, on a probe of its own letters, the model alone gives other ids.
        """
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)["model"]
        if parts.get("type") != "BPE" or not parts.get("end_of_word_suffix") or len(self.mark) != 1:
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parts["merges"]]
        lean = Tokenizer(models.BPE(vocab=parts["vocab"], merges=merges, end_of_word_suffix=parts["end_of_word_suffix"], cache_capacity=0))
        lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = [chr(c).encode() for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        probe = [a + b + c for a in letters for b in letters[::5] for c in (b"ing", b"\xc3\xa9", b"")]
        same = np.array_equal(self._ids(b" ".join(probe)), self._lean_ids(lean, b" ".join(probe)))
        return lean if same and np.array_equal(self._lean_ids(lean, self.MARK), self.mark) else None

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _lean_ids(lean, text: bytes) -> np.ndarray:  # noqa: ANN001
        shown = text.decode("latin-1")
        for byte, letter in BYTE_LETTERS:
            shown = shown.replace(byte, letter)
        return np.array(lean.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        alone = [w for w in words if self.MARK in w or len(self.mark) != 1]
        out = {w: self._ids(w).tobytes() for w in alone}
        lean = [w for w in words if PLAIN(w)] if self.plain else []
        rest = list(set(words).difference(lean, out)) if len(lean) < len(words) else []
        for some, ids_of in ((lean, lambda text: self._lean_ids(self.plain, text)), (rest, self._ids)):
            for at in range(0, len(some), 5000):
                part = some[at : at + 5000]
                ids = ids_of((b" " + self.MARK + b" ").join(part))
                ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
                raw = ids.tobytes()
                out.update(zip(part, (raw[4 * lo : 4 * hi] for lo, hi in zip([0, *(e + 1 for e in ends)], ends))))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Arrow splits and numbers the words, so that Python sees each different one once; ids are gathered by these numbers.
        """
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        # A-Z become small here, so that fewer words differ; not where a special token's string could come about
        lower = pa.array([x if b"<|" in x else x.lower() for x in raw], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(lower)
        numbered = split.flatten().dictionary_encode()
        place, ends = numbered.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        ids, size = self._of_words(numbered.dictionary)
        start = np.cumsum(size) - size
        for lo, hi in zip(ends[:-1], ends[1:]):
            yield _gathered(ids, start, size, place[lo:hi]).tobytes()

    def _of_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one word after the other, and their numbers of ids.

        Marks after a word's last letter are tokens of their own, so such a word is put together from two parts.
        """
        low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        stem = pc.ascii_rtrim(low, characters=TAIL.decode())
        short, whole = (pc.binary_length(x).to_numpy() for x in (stem, low))
        text = np.frombuffer(stem.buffers()[2] or b"", np.uint8)
        last = np.zeros(len(short), np.uint8)
        last[short > 0] = text[np.cumsum(short)[short > 0] - 1] | 32
        parted = (short < whole) & (last >= ord("a")) & (last <= ord("z"))
        coded = pc.if_else(pa.array(parted), stem, low).dictionary_encode()
        parts = _listed(coded.dictionary)
        tails = {b"": 0}
        second = np.zeros(len(short), np.int64)
        ended = _listed(low.filter(pa.array(parted)))
        second[parted] = [tails.setdefault(word[n:], len(tails)) for word, n in zip(ended, short[parted].tolist())]
        ids = self._cached([*parts, *tails])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        pairs = np.stack([coded.indices.to_numpy(), len(parts) + second], 1)
        return _gathered(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, size, pairs.ravel()), size[pairs].sum(1)

    def _cached(self, words: list[bytes]) -> list[bytes]:
        """The ids of small words; those that the cache doesn't have are encoded together."""
        if len(self.known) > WORD_CACHE:
            self.known, self.older = {}, self.known
        known, older, local = self.known, self.older, {b"": b""}
        fresh = [w for w in dict.fromkeys(words) if w and w not in known]
        known.update((w, older[w]) for w in fresh if w in older)
        for word, ids in self.encoded([w for w in fresh if w not in older]).items():
            (known if len(word) <= LONGEST_CACHED else local)[word] = ids
        return [known[w] if w in known else local[w] for w in words]


def _listed(words: pa.LargeStringArray) -> list[bytes]:
    """As ``to_pylist`` of the bytes, without a scalar for each."""
    return words.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of a row of words by their numbers."""
    n = size[words]
    upto = np.cumsum(n)
    return ids[np.repeat(start[words] + n - upto, n) + np.arange(upto[-1] if len(n) else 0)]


_encoders: dict[str, WordEncoder] = {}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per document the pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32.

    A document's ids are those of its whole text and ``end_id``; a null text is empty. The file at
    ``tokenizer_path`` must be readable on every executor.
    """

    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODED_TOGETHER):
                part = batch.slice(lo, ENCODED_TOGETHER)
                out: list[tuple] = []
                for key, ids in zip(part["id"].to_pylist(), encoder.encode([x or "" for x in part["text"].to_pylist()])):
                    coded = ids + end
                    for piece, start in enumerate(range(0, len(coded) // 4, capacity)):
                        own = coded[4 * start : 4 * (start + capacity)]
                        out.append((key, piece, start, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES)], _PIECE_NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Run:
    """Documents of ``length`` with ranks from ``rank`` on, placed at ``offset`` of the sequences from ``sequence`` on."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[Run]:
    """Match runs of documents with runs of gaps, best fit in descending order of length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, count)
    sizes: list[int] = []  # gaps that have ranges, ascending
    opened = 0
    runs = []

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fresh = -(-left // (capacity // length))
                add(capacity, opened, fresh)
                opened += fresh
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            took = min(count, left)
            add(gap, first + took, count - took)
            add(gap - length, first, took)
            runs.append(Run(length, rank, took, first, capacity - gap))
            rank, left = rank + took, left - took
    return runs


def ranked(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``rank``, the place of a piece among those of its length, from 0.

    A length with many pieces is dealt to as many shares as its count asks for; the pieces are range-sorted
    by length and share, ranked within the share, and moved up by the sizes of the shares before. The share comes from the
    written row number ``_row``, so equal rows are dealt apart.
    ``sizes`` has a row for each length, no more than the capacity.
    """
    shares = sizes.select("length", F.ceil(F.col("n") / RANKED_TOGETHER).alias("shares"))
    dealt = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("_row"), F.col("shares")))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "share").orderBy("id", "piece", "ids_crc32", "_row")
    sorted_ = dealt.repartitionByRange("length", "share").withColumn("at", F.row_number().over(within))
    return sorted_.join(ahead, ["length", "share"]).withColumn("rank", F.col("ahead") + F.col("at") - 1).drop("shares", "share", "at", "ahead")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` of 1 to ``capacity``; every row is placed once.

    Needs the columns id, piece, ids_crc32 (only to order equal lengths; nulls and repeated rows are
    fine, each row gets its own place) and length; a null length is an error. An empty table gives an empty table.
    """
    columns, schema = pieces.columns, pieces.schema
    pieces = staged(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")  # deals equal rows apart
    sizes = staged(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    runs = best_fit_runs({r["length"]: r["n"] for r in sizes.collect()}, capacity)
    order = sorted(runs, key=lambda r: (r.length, r.rank))
    starts = np.array([(r.length, r.rank) for r in order], np.int64).reshape(-1, 2)
    keys = starts[:, 0] * (1 << 44) + starts[:, 1]
    base = np.array([(r.sequence - r.rank, r.offset) for r in order], np.int64).reshape(-1, 2)
    held = pieces.sparkSession.sparkContext.broadcast((keys, base))  # bounded by the capacity, see the module

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base = held.value
        for batch in batches:
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch["length"].to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 44) + rank, side="right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(base[at, 0] + rank), pa.array(base[at, 1])], [*kept, "sequence_id", "offset"])

    placed = ranked(pieces, sizes).select(*columns, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return placed.mapInArrow(match, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize whole documents and pack them: one row per piece with id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents with more ids than ``capacity`` are cut. Null and empty texts are the one id
    ``end_id``; null ids and repeated rows are packed like any other row; other columns are not read.
    """
    placed = pack(tokenized_pieces(docs, tokenizer_path, id_col, text, capacity, end_id), capacity)
    return placed.withColumnRenamed("id", id_col)
