import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailmark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_a_packing_as_good_as_the_sequential_one(seed):
    rnd = random.Random(seed)
    lengths = [min(64, max(1, int(rnd.lognormvariate(2.5, 1)))) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_runs(counts, 64)
    filled = {}
    for r in runs:
        for i in range(r.count):
            filled.setdefault(r.sequence + i, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 64
    assert sum(map(len, filled.values())) == 400
    assert len(filled) <= best_fit_decreasing(lengths, 64) + 1
    assert sorted(filled) == list(range(len(filled)))


def test_words_have_the_tokenizers_ids():
    plain = Tokenizer.from_file(PATH)
    texts = ["<|ENDOFTEXT|> Ab", "Été ÜBER naïve ÿß÷× Straße\xad x\xa0y", "Hello, WORLD's end.&&& don't stop\x1ethere", "a\x01b \x01 c", "é é İ ß ﬁ 文字", "x" * 300 + "!!! ...", "<|endoftext|> a<|startoftext|>b", "", "'s, 't. 1.2.3 #$%", "abc.def, ghi.　jkl\x85m"]
    coded = packing.WordEncoder(PATH).encode(texts)
    for text, ids in zip(texts, coded):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_awkward_documents(awkward, empty):
    rows = packing.pack_documents(awkward, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc in awkward.collect():
        ids = plain.encode(doc.text or "", add_special_tokens=False).ids + [1]
        want += [(doc.doc_id, i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 4096
    assert packing.pack_documents(empty, PATH).count() == 0


def test_hot_length_is_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    pieces = spark.range(500).selectExpr("id", "0 as piece", "id as ids_crc32", "cast(if(id % 3 = 0, 5, id % 7 + 1) as bigint) as length")
    rows = packing.pack(pieces, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500 == len({r.id for r in rows})
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 16) + 1


def test_words_meet_python_once(monkeypatch):
    encoder = packing.WordEncoder(PATH)
    seen, cached = [], encoder._cached
    monkeypatch.setattr(encoder, "_cached", lambda words: seen.append(words) or cached(words))
    texts = ["", " \n\t ", "", "Lead, lead; (lead) 12, 12", "a,b , ,; x\x0b\x1cy", "<|endoftext|> Foo <|x FOO,", "ünïcödé, 文字列の例 \x85 नमस्ते 🙂 \x00\x01 q\x01r", "w" * 500 + "!", "lead " * 3000]
    plain = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == plain
    assert all(len(words) < 40 and words.count(b"lead") == 1 for words in seen)
