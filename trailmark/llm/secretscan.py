"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they don't cover.

The field tags the tokens of each line as begin, inside or outside of a secret. A token's features are its
shape, length, kinds of characters and, if it is one of the words that stand before known secrets, itself;
they act on its own tag and, with weights of their own, on the tags of the next two tokens and of the one
before. Features of the document (share of symbols, size) act on every token. Weights are fitted by the
likelihood of whole lines (forward-backward); tags are decoded by Viterbi.

Learned from at most ``max_documents`` documents, in order of a hash of their id: the values the fixed
patterns find there are the tagged secrets, the rest of their lines and tokens that look alike elsewhere
the counter-examples.

Decoding skips lines in which no token can be part of a secret on any best path. With g the largest gain of
any transition over outside-outside, a segment of n tokens gains at most sum(d + g) + g over tagging
it outside, d being a token's advantage inside; so some token needs d > -2 g. This loses nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"\n|[^\W_][\w+/-]*|[^\s]")
TAGS = 3  # outside, begin, inside
O, B, I = range(TAGS)


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Spans of the fixed patterns as (kind, start, end, value start, value end), by start, then kind as listed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", m.start(), m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _bucket(n: int) -> int:
    return n if n < 4 else int(2 * math.log2(n))


def shape(token: str) -> str:
    """Kinds of characters in order, runs as one: A upper, a lower, 0 digit, - other; at most six."""
    out = ""
    for c in token:
        kind = "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else "-"
        if out[-1:] != kind:
            out += kind
            if len(out) == 6:
                break
    return out


def word_class(token: str, cues: frozenset[str]) -> tuple | None:
    """What the features of a lower-case or capitalised word depend on; None for any other token."""
    if not token.isalpha() or not (token.islower() or token[1:].islower() and token[0].isupper()):
        return None
    size = len(token)
    return token[0].isupper(), _bucket(size), round(len(set(token)) / size * 4) if size >= 8 else -1, token.lower() if token.lower() in cues else ""


def features(token: str, cues: frozenset[str]) -> list[str]:
    """Names of a token's features."""
    if len(token) == 1 and not token.isalnum():
        return ["mark", f"mark {token}"]
    digits = sum(c.isdigit() for c in token)
    kinds = (any(c.isupper() for c in token), any(c.islower() for c in token), digits > 0)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    out = ["word", f"shape {shape(token)}", f"folded {shape(token.lower())} {_bucket(len(token))}", f"length {_bucket(len(token))}", f"kinds {kinds}", f"digits {_bucket(digits)}", f"changes {_bucket(changes)}"]
    if digits and not set(token) - set("0123456789abcdefABCDEF"):
        out.append(f"hexadecimal {len(token) >= 16} {digits == len(token)}")
    if len(token) >= 8:
        out.append(f"spread {round(len(set(token)) / len(token) * 4)} {kinds}")
    if token.lower() in cues:
        out.append(f"cue {token.lower()}")
    return out


def document_features(text: str) -> list[str]:
    marks = sum(text.count(c) for c in "={}[]();:#$%&*\"'")
    return [f"file marks {_bucket(int(200 * marks / max(len(text), 1)))}", f"file size {_bucket(len(text) // 200)}"]


PLACES = ("own ", "before ", "second before ", "after ")


@dataclass
class Field:
    """Fitted weights: a few thousand rows of three numbers, transitions and start scores."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    cues: frozenset[str]

    def sums(self, own: list[str], place: str) -> np.ndarray:
        known = [self.names[place + f] for f in own if place + f in self.names]
        return self.weights[known].sum(axis=0) if known else np.zeros(TAGS)

    def token_rows(self, token: str) -> np.ndarray:
        own = features(token, self.cues)
        return np.concatenate([self.sums(own, p) for p in PLACES])

    def file_row(self, text: str) -> np.ndarray:
        return self.sums(document_features(text), "file ")


def emissions(rows: np.ndarray, file_row: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Scores of the tags of consecutive tokens from their feature sums; lines don't see each other."""
    out = rows[:, :TAGS] + file_row
    line = np.cumsum(breaks)
    for shift, at in ((1, TAGS), (2, 2 * TAGS)):
        same = line[shift:] == line[:-shift]
        out[shift:] += np.where(same[:, None], rows[:-shift, at : at + TAGS], 0)
    same = line[1:] == line[:-1]
    out[:-1] += np.where(same[:, None], rows[1:, 3 * TAGS :], 0)
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray, start: np.ndarray) -> list[int]:
    """The best tags of one line; the smaller tag of equals."""
    best = scores[0] + start
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, len(scores)):
        each = best[:, None] + moves
        back[t] = each.argmax(axis=0)
        best = each[back[t], np.arange(TAGS)] + scores[t]
    tags = [int(best.argmax())]
    for t in range(len(scores) - 1, 0, -1):
        tags.append(int(back[t][tags[-1]]))
    return tags[::-1]


def segments(tags: list[int]) -> list[tuple[int, int]]:
    """(first, last) token of each tagged secret."""
    out: list[tuple[int, int]] = []
    for i, tag in enumerate(tags):
        if tag == B or tag == I and not (i and tags[i - 1] != O):
            out.append((i, i))
        elif tag == I:
            out[-1] = (out[-1][0], i)
    return out


class Scanner:
    """Finds the field's spans in whole texts; keeps the feature sums of words it has seen, up to a bound."""

    most = 300_000

    def __init__(self, model: Field) -> None:
        self.model = model
        self.gain = float(max(model.moves.max(), (model.start - model.start[O] + model.moves[O, O]).max()) - model.moves[O, O])
        self.codes: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}  # tokens of a class have the same features
        self.rows = np.zeros((1024, TAGS * len(PLACES)))

    def coded(self, tokens: list[str]) -> np.ndarray:
        """A number for each token, under which its feature sums are kept."""
        known = self.codes
        if len(known) > self.most:
            known.clear()
        for token in set(tokens).difference(known):
            key = word_class(token, self.model.cues)
            if key not in self.classes:
                own = features(token, self.model.cues)
                key = key or tuple(own)
                if key not in self.classes:
                    self.classes[key] = len(self.classes)
                    if len(self.classes) > len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[self.classes[key]] = self.model.token_rows(token)
            known[token] = self.classes[key]
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens or not len(self.model.names):
            return []
        codes = self.coded(tokens)
        breaks = np.fromiter((t == "\n" for t in tokens), bool, len(tokens))
        scores = emissions(self.rows[codes], self.model.file_row(text), breaks)
        ahead = scores[:, 1:].max(axis=1) - scores[:, O]
        seeds = np.flatnonzero((ahead > -2 * self.gain) & ~breaks)
        if not len(seeds):
            return []
        ends = np.flatnonzero(breaks)
        lines = sorted({(int(ends[k - 1]) + 1 if k else 0, int(ends[k]) if k < len(ends) else len(tokens)) for k in np.searchsorted(ends, seeds).tolist()})
        found = [(lo + a, lo + b) for lo, hi in lines for a, b in segments(viterbi(scores[lo:hi], self.model.moves, self.model.start))]
        if not found:
            return []
        at = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        return [(at[a][0], at[b][1]) for a, b in found]


def _forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, tag and transition expectations of padded lines (lines, length, tags)."""
    n, length, _ = scores.shape
    alpha = np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0] + start
    for t in range(1, length):
        nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
        alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
    total = np.logaddexp.reduce(alpha[:, -1], axis=1)
    beta = np.zeros_like(scores)
    pairs = np.zeros((TAGS, TAGS))
    for t in range(length - 1, 0, -1):
        inner = scores[:, t] + beta[:, t]
        joint = alpha[:, t - 1, :, None] + moves + inner[:, None, :] - total[:, None, None]
        pairs += np.exp(joint[mask[:, t]]).sum(axis=0)
        beta[:, t - 1] = np.where(mask[:, t, None], np.logaddexp.reduce(moves + inner[:, None, :], axis=2), beta[:, t])
    marginals = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    return float(total.sum()), marginals, pairs, marginals[:, 0].sum(axis=0)


def train(lines: list[tuple[list[str], list[int], list[str]]], cues: frozenset[str], rounds: int = 120, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty by adaptive gradient steps. ``lines``: tokens, tags, document features."""
    names: dict[str, int] = {}
    cache: dict[str, list[str]] = {}
    length = max(len(t) for t, _, _ in lines)
    gold = np.zeros((len(lines), length), np.int64)
    mask = np.zeros((len(lines), length), bool)
    places, active = [], []
    for k, (tokens, tags, whole) in enumerate(lines):
        gold[k, : len(tags)] = tags
        mask[k, : len(tags)] = True
        own = [cache.setdefault(t, features(t, cues)) for t in tokens]
        for i in range(len(tokens)):
            here = ["file " + f for f in whole] + [PLACES[0] + f for f in own[i]]
            for place, j in ((PLACES[1], i - 1), (PLACES[2], i - 2), (PLACES[3], i + 1)):
                if 0 <= j < len(tokens):
                    here += [place + f for f in own[j]]
            active += [names.setdefault(f, len(names)) for f in here]
            places += [k * length + i] * len(here)
    rows, cols = np.array(places), np.array(active)
    one = np.zeros((len(lines) * length, TAGS))
    one[np.flatnonzero(mask.ravel()), gold.ravel()[mask.ravel()]] = 1
    seen_moves = np.zeros((TAGS, TAGS))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(seen_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_start = np.bincount(gold[:, 0], minlength=TAGS).astype(float)
    params = [np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, moves, start = params
        picked = w[cols]
        scores = np.stack([np.bincount(rows, weights=picked[:, t], minlength=len(lines) * length) for t in range(TAGS)], axis=1)
        _, tag, pairs, first = _forward_backward(scores.reshape(len(lines), length, TAGS), mask, moves, start)
        diff = (one - tag.reshape(-1, TAGS))[rows]
        grads = [np.stack([np.bincount(cols, weights=diff[:, t], minlength=len(names)) for t in range(TAGS)], axis=1) - ridge * w, seen_moves - pairs - ridge * moves, seen_start - first - ridge * start]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] + 0.15 / math.sqrt(1 + step / 20) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    return Field(names, *params, cues)


WINDOW = 12


def windows(text: str, most: int = 8) -> list[tuple[list[str], list[int], bool]]:
    """Training windows of one document: tokens around known values, around tokens that look like them, and the document's first line."""
    at = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    tags = [O] * len(at)
    starts = [a for a, _, _ in at]
    known = []
    for _, _, _, lo, hi in base_spans(text):
        first = int(np.searchsorted(starts, lo, side="right")) - 1
        last = int(np.searchsorted(starts, hi, side="left")) - 1
        if first < 0:
            continue
        if tags[first] == O:
            tags[first] = B
            known.append(first)
        for i in range(first + 1, last + 1):
            tags[i] = I if tags[i] == O else tags[i]
    alike = [i for i, (_, _, t) in enumerate(at) if tags[i] == O and len(t) >= 5 and any(c.isdigit() for c in t)]
    plain = list(range(0, len(at), max(1, len(at) // 3)))[:3]
    out = []
    for positive, spots in ((True, known), (False, alike), (False, plain)):
        for i in spots[:most]:
            lo, hi = max(0, i - WINDOW), min(len(at), i + WINDOW)
            newlines = [j for j in range(lo, hi) if at[j][2] == "\n"]
            lo = max([lo, *(j + 1 for j in newlines if j < i)])
            hi = min([hi, *(j for j in newlines if j >= i)])
            if lo < hi:
                out.append(([t for _, _, t in at[lo:hi]], tags[lo:hi], positive))
    return out


def fit(docs: DataFrame, *, max_documents: int = 6000, max_windows: int = 1500, id_col: str = "doc_id", text: str = "text") -> Field:
    """Fit the field on a bounded sample of documents; without known secrets in it, the field tags nothing."""
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, x in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                out += [(key, n, t, g, p, document_features(x)) for n, (t, g, p) in enumerate(windows(x or ""))]
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["id", "n", "tokens", "tags", "positive", "file"])

    made = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id")
    windows_ = made.mapInArrow(cut, "id bigint, n int, tokens array<string>, tags array<int>, positive boolean, file array<string>").distinct().persist()
    rows = []
    for positive in (True, False):
        rows += windows_.filter(F.col("positive") == positive).orderBy(F.xxhash64("id", "n"), "id", "n", "tokens").limit(max_windows).collect()
    windows_.unpersist()
    if not any(r["positive"] for r in rows):
        return Field({}, np.zeros((0, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS), frozenset())
    near, far, met = Counter(), Counter(), set()
    for r in rows:
        if tuple(r["tokens"]) in met:  # a copied passage is one case
            continue
        met.add(tuple(r["tokens"]))
        first = {j for i, t in enumerate(r["tags"]) if t == B for j in range(max(0, i - 3), i)}
        for j, t in enumerate(r["tokens"]):
            if len(t) > 1:
                (near if j in first else far)[t.lower()] += 1
    cues = frozenset(t for t, n in near.items() if n >= 3 and n > far[t])
    return train([(r["tokens"], r["tags"], r["file"]) for r in rows], cues)


def scan(docs: DataFrame, model: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    ``spans`` lists kind:start:end of all spans by start, then kind, comma-joined, in code points with
    exclusive ends; a span of the field that overlaps one of the fixed patterns is not repeated. A null text
    is empty and has no spans; null ids and repeated rows are scanned like others; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for x in batch["text"].to_pylist():
                x = x or ""
                base = [(k, s, e) for k, s, e, _, _ in base_spans(x)]
                added = [("crf", s, e) for s, e in scanner.spans(x) if not any(s < b and a < e for _, a, b in base)]
                kinds = Counter(k for k, _, _ in base)
                shown = [",".join(f"{k}:{s}:{e}" for k, s, e in some) for some in (base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))))]
                for column, value in zip(out, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(shown[0].encode()).hexdigest(), shown[1], len(added))):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(c, t) for c, t in zip(out, types)]], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    found = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(find, "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")
    return found.withColumnRenamed("id", id_col)
