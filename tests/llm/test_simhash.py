import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import simhash
from trailmark.llm.common import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values):
    at = np.array(values, np.uint64)
    near = np.bitwise_count(at[:, None] ^ at[None]) <= 2
    label = np.arange(len(at))
    while True:
        new = np.where(near, label[None], len(at)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint_is_the_plain_one():
    for text in (None, "", " \n", "One", "one two", "A b C d a b c", "ä Ä ß\x0b x " * 50, "w" * 5000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_of_planted_clusters(spark):
    rnd = random.Random(3)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for base in values[:6]:
        values += [base ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(8)]
    hub = rnd.getrandbits(64)  # a key that far more fingerprints share than are paired
    values += [hub ^ sum(1 << b for b in rnd.sample(range(40, 64), rnd.randrange(4))) for _ in range(500)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for limit in (64, 4, 10_000):
        found = dict(components(simhash.near_pairs(df, pair_limit=limit)).collect())
        want = plain_classes(values)
        groups = {}
        for v, c in zip(signed, want):
            groups.setdefault(c, set()).add(v)
        got = {}
        for v in signed:
            got.setdefault(found.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_awkward_documents(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    source = [(r.doc_id, r.text) for r in awkward.collect()]
    values = [plain_fingerprint(t) for _, t in source]
    labels = plain_classes(values)
    want = []
    for (key, _), v, c in zip(source, values, labels):
        ids = [k for (k, _), d in zip(source, labels) if d == c and k is not None]
        want.append((key, f"{v:016x}", min(ids, default=None)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(300, 600).select(F.lit(299), "id"))
    found = components(edges)
    assert found.filter("node <= 200").select("component").distinct().collect() == [(0,)]
    assert found.filter("node > 200").groupBy("component").count().collect() == [(299, 300)]
