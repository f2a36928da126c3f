"""Repairs against a search over all edits, with blocks of a few rows as well as whole conversations."""

import hashlib
import random
import sys

import pytest

from trailmark.llm import repair

SPACES = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)


def best_edits(rows):
    """Least (cost, audit, pieces) over all edits of rows (role, text, must go, extra cost)."""
    known = {}

    def search(i, state, inserts):
        key = (i, state, inserts)
        if key not in known:
            options = [(0, "", [])] if i == len(rows) and state in "0a" else []
            new = "a" if state == "u" else "u"
            word = {"u": "user", "a": "assistant"}[new]
            if inserts < 3:
                c, t, p = search(i, new, inserts + 1)
                options.append((c + 5, "I" + t, [word + ":"] + p))
            if i < len(rows):
                role, text, must, more = rows[i]
                c, t, p = search(i + 1, state, 0)
                options.append((c + 2, "D" + t, p))
                if not must:
                    c, t, p = search(i + 1, new, 0)
                    options.append((c + 1 + more, "R" + t, [word + ":" + text] + p))
                    if role[:1] and role[:1] in {"0": "su", "s": "u", "u": "a", "a": "u"}[state]:
                        c, t, p = search(i + 1, role[0], 0)
                        options.append((c + more, "K" + t, [role + ":" + text] + p))
            known[key] = min(options, key=lambda o: o[:2], default=(10**9, "~", []))
        return known[key]

    return search(0, "0", 0)


def expected(rows):
    """Digest of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
    cost, audit, pieces = best_edits(marked)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())


def made(seed, longest):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "cut", "cut off ", "Four. \n", "", " \t", None, "ü。", "End.\u2028", "a.\x00", "Same."]
    rows = []
    for conv in [None, *range(25)]:
        for k in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([None, k, k, k, k // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None, "ua"]), rng.choice(texts) if rng.random() < 0.5 else f"t{k}."))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, mark string, seq int, blk int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA).repartition(3)


def digests(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def by_conversation(rows):
    whole = {}
    for conv, *rest in rows:
        whole.setdefault(conv, []).append(tuple(rest))
    return whole


@pytest.mark.parametrize("block,longest", [(1 << 16, 8), (4, 14), (1, 6)])
def test_against_search(spark, monkeypatch, block, longest):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made(block, longest)
    assert digests(repair.repair(frame(spark, rows))) == {c: expected(r) for c, r in by_conversation(rows).items()}


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    rng = random.Random(3)
    rows = [(1, k // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"{k}.", f"{k}", ""])) for k in range(900)]
    assert digests(repair.repair(frame(spark, rows)))[1] == expected([r[1:] for r in rows])


def test_equal_rows_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 8)
    rows = [(1, None, "user", "Hello.")] * 100 + [(1, 1, "assistant", "Yes.")] * 30 + [(1, 2, "user", "x" * 100_000)]
    assert digests(repair.repair(frame(spark, rows)))[1] == expected([r[1:] for r in rows])


def damaged(rows):
    import zlib

    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, "user" if kind == 4 else role, text


def test_damage(spark):
    rows = made(9, 5) + [(c, 1, "user", "Hi.") for c in range(100, 200)]
    whole = by_conversation(damaged(rows))
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    ids = {r[0] for r in rows}
    assert any(c not in whole for c in ids)
    assert digests(repair.repair_damaged(frame(spark, rows))) == {c: expected(whole[c]) if c in whole else gone for c in ids}


def test_empty(spark):
    assert repair.repair_damaged(frame(spark, made(1, 1)).limit(0)).count() == 0


def test_walk_keeps_checkpoints_only():
    step, kept = repair._checkpoints("u" * 10_000, repair.END)
    assert step == 100 and len(kept) == 100
