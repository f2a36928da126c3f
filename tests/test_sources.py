"""Readers and writers on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trailmark.operators import summaries as R
from trailmark.sources import readers as IN
from trailmark.sources import writers as OUT


def put(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as out:
        out.write(text)
    return path


def record(qid, ok):
    return json.dumps({"question_id": qid, "answer": "x", "is_correct": ok, "judge_complete_status": "SUCCESS", "judge_metrics": {"f1": 1.0}})


def test_legacy_log_wins_and_malformed_lines_are_counted(spark, folder):
    put(f"{folder}/rollout_0/000_review/review.jsonl", record("a", True) + "\n\n" + record("a", True) + "\n[1]\n{oops\n" + record(" ", True))
    put(f"{folder}/rollout_0/review.jsonl", record("a", False) + "\n")
    put(f"{folder}/rollout_1/review.jsonl", record("b", True) + "\n")
    lines = IN.read_review_lines(spark, folder)
    latest = {(r.rollout_idx, r.question_id): r.is_correct for r in R.latest_reviews(R.reviews_from_lines(lines)).collect()}
    assert latest == {(0, "a"): "false", (1, "b"): "true"}
    assert {r.rollout_idx: r.malformed_review_lines for r in R.line_quality(lines).collect()} == {0: 3, 1: 0}


def test_review_discovery(spark, folder):
    a = put(f"{folder}/rollout_0/review.jsonl", record("a", True))
    put(f"{folder}/rollout_0/000_review/review.jsonl", record("a", True))
    assert len(IN.find_review_files(spark, [a, a], folder)) == 2
    with pytest.raises(FileNotFoundError):
        IN.find_review_files(spark, [f"{folder}/missing.jsonl"])


def test_strict_lines_name_the_place(spark, folder):
    lines = IN.read_lines(spark, put(f"{folder}/x.jsonl", '{"a": 1}\n\n{bad\n'))
    with pytest.raises(Exception, match=r"x\.jsonl:3"):
        IN.strict_records(lines).collect()
    assert IN.tolerant_records(lines).count() == 1


def test_bom_csv(spark, folder):
    path = put(f"{folder}/x.csv", '﻿problem,answer\n"two\nlines, ""q""",1\n')
    rows = IN.read_csv(spark, path, ["problem", "answer"]).collect()
    assert [(r.problem, r.answer) for r in rows] == [('two\nlines, "q"', "1")]
    with pytest.raises(ValueError, match="answer_type"):
        IN.read_csv(spark, path, ["answer_type"])


def test_question_lines(spark, folder):
    path = put(f"{folder}/q.jsonl", '{"extra_info": {"item_id": "i", "question": "?"}, "reward_model": {"ground_truth": "one"}}\n')
    row = IN.read_questions(spark, path).first()
    assert (row.question_id, row.ground_truth, row.benchmark, row.judge_metadata) == ("i", ["one"], "browsecomp", {})
    bad = put(f"{folder}/bad.jsonl", '{"extra_info": \n')
    with pytest.raises(Exception):
        IN.read_questions(spark, bad).collect()
    with pytest.raises(ValueError):
        IN.read_questions(spark, "x.csv")


def test_gold_folder(spark, folder):
    put(f"{folder}/w1.csv", "﻿A Col,b\n1,2\n\n3,4\n")
    r = IN.read_gold_folder(spark, folder).first()
    assert (r.instance_id, r.columns, r.rows) == ("w1", ["acol", "b"], 2) and r.gold_csv.startswith("A Col")


def test_segments(spark, folder):
    put(f"{folder}/rollout_2/question_q/answer_t3_attempt_1_0.jsonl", '{"role": "user"}\n{"role": "assistant"}\n')
    put(f"{folder}/rollout_2/question_q/segment_4.jsonl", '{"role": "user"}\n')
    got = sorted((r.state or "", r.transition, r.attempt, r.segment, r.seq) for r in IN.read_segments(spark, folder).collect())
    assert got == [("", None, None, 4, 0), ("ANSWER", 3, 1, 0, 0), ("ANSWER", 3, 1, 0, 1)]


def test_canonical_write_guards_rows(spark, folder):
    df = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in OUT.CANONICAL_COLUMNS])
    with pytest.raises(ValueError, match="expected 4"):
        OUT.write_canonical(df, f"{folder}/t.parquet", 4)
    assert not os.path.exists(f"{folder}/t.parquet")
    OUT.write_canonical(df, f"{folder}/t.parquet", 3)
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 3


def test_positions_over_many_files(spark, folder):
    spark.range(100).repartition(7).write.parquet(f"{folder}/p")
    got = IN.with_position(spark, f"{folder}/p")
    assert sorted(r.position for r in got.collect()) == list(range(100))


def test_rejudge_never_overwrites(spark, folder):
    assert OUT.rejudge_path("a/review.jsonl") == "a/review.official_judge.jsonl"
    with pytest.raises(ValueError):
        OUT.write_rejudged(spark.range(1), f"{folder}/x.jsonl", f"{folder}/x.jsonl")


def test_fingerprint(spark, folder):
    import hashlib

    path = put(f"{folder}/f.txt", "hello")
    assert OUT.fingerprints(spark, path).first().sha256 == hashlib.sha256(b"hello").hexdigest()


def test_fingerprints_of_pieces(spark, folder):
    """Digests of files read in many splits equal those of the whole files, whatever their bytes."""
    import gzip
    import hashlib
    import os
    import random

    rng = random.Random(2)
    bom = b"\xef\xbb\xbf"
    contents = [b"", b"\n", b"\n\n", b"a", b"a\n", b"a\r\nb", bom, bom + b"x\n", bom + b"\n" + bom, bom + b"no end", b"x" * 50_000, rng.randbytes(400_000), b"line\n" * 90_000, "ü€🙂\n".encode() * 9, gzip.compress(b"packed")]
    for i, c in enumerate(contents):
        name = f"{folder}/d{i % 3}/f {i}%41." + ("gz" if i == len(contents) - 1 else "bin")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as f:
            f.write(c)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = {(r.length, r.sha256) for r in OUT.fingerprints(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {(len(c), hashlib.sha256(c).hexdigest()) for c in contents if c}


def test_snapshot_scan(spark, folder):
    """Files of any folder depth; a broken one keeps its name, its text and no fields; look-up by name and by inner id."""
    import json
    import os

    from trailmark.operators import memory as M

    files = {
        "trajectories/question_a b/memory/m-1-22.json": {"memory_id": "x-1", "knowledge_graph": [{"fact": "f"}]},
        "retry_history/question_a b/attempt_2/memory/snap-m122-z.json": {"memory_id": "m-1-22"},
        "retry_history/question_a b/attempt_10/memory/other.json": {"memory_id": "deep-id"},
        "retry_history/question_a b/attempt_2/memory/cut-77.json": None,
        "trajectories/question_b/memory/list.json": [1, 2],
    }
    for name, value in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(json.dumps(value, indent=2) if value is not None else '{"memory_id": "cut-')
    found = IN.read_snapshots(spark, folder)
    rows = {(r.question_id, r.folder, r.stem): (r.memory_id, r.unreadable is not None) for r in found.collect()}
    assert rows[("a b", "memory", "m-1-22")] == ("x-1", False) and rows[("a b", "attempt_2/memory", "cut-77")] == (None, True)
    assert rows[("a b", "attempt_10/memory", "other")] == ("deep-id", False)
    asked = spark.createDataFrame([("a b", w) for w in ("m-1-22", "1-22", "deep-id", "77", "cut", "ut-7", "snap", "m-122", "122", "-m1", "nothing", "x-1", "m-1-22-longer-than-any-name", "")], "question_id string, wanted string")
    got = {r.wanted: (r.stem, r.match) for r in M.lookup(asked, found).collect()}
    assert got == {
        "m-1-22": ("m-1-22", 1), "1-22": ("m-1-22", 1), "deep-id": ("other", 3), "77": ("cut-77", 1), "cut": ("cut-77", 3), "ut-7": ("cut-77", 3), "snap": ("snap-m122-z", 3),
        "122": ("snap-m122-z", 3), "-m1": ("snap-m122-z", 3), "x-1": ("m-1-22", 3),
    }


def test_packed_snapshots_read_like_files(spark, folder):
    """Documents packed as JSON lines give the rows their files give: whole, cut off, empty, no object, and with line breaks inside."""
    texts = [json.dumps({"memory_id": "m-1", "knowledge_graph": [{"fact": "a\nb"}], "task_progress": None}, indent=2), '{\n  "memory_id" : "m', "[1, 2]", "3", "", "no json", '{"memory_id": "é\\u00fc"}']
    rows = [(f"question_q {i}/attempt_{i}+x/memory/s.{i}.json", t) for i, t in enumerate(texts)]
    for name, value in rows:
        put(f"{folder}/files/{name}", value)
    IN.write_packed(spark.createDataFrame(rows, "path string, text string").repartition(2), f"{folder}/packed")
    assert len([n for n in os.listdir(f"{folder}/packed") if n.startswith("part-")]) == 2
    seen = lambda df: sorted(str(r) for r in df.select("question_id", "folder", "stem", "memory_id", F.to_json("knowledge_graph"), "task_progress", "unreadable").collect())
    got = seen(IN.read_packed_snapshots(spark, f"{folder}/packed"))
    (empty,) = [r for r in got if "s.4" in r]  # a file without bytes gives Spark's reader no row at all
    assert "unreadable=''" in empty and [r for r in got if r != empty] == seen(IN.read_snapshots(spark, f"{folder}/files"))


def test_scan_queries_write_few_files(spark, folder, monkeypatch):
    """The files that the scans write must not grow with the number of documents: 300 questions once made 1,200 of them."""
    import __spark_entry__ as entry
    from trailmark.catalog import benchmark_cases, trajectory_cases
    from trailmark.plans import staging

    events = spark.range(1200).selectExpr("id AS event_id", "id % 300 AS user_id", "'view' AS event_type", "1.5D AS value", """'{"k": 4}' AS props""")
    events.write.parquet(f"{folder}/data/events.parquet")
    spark.range(300).selectExpr("id AS doc_id", "concat('x,y\n1,2\n', id) AS text").write.parquet(f"{folder}/data/documents.parquet")
    for module in (benchmark_cases, trajectory_cases, staging):
        monkeypatch.setattr(module, "checkpoint_folder", lambda spark: f"{folder}/scratch")
    assert entry.queries()["src13_snapshot_scan"](spark, f"{folder}/data").count() == 300
    assert {r["rows"] for r in entry.queries()["src6_gold_tables"](spark, f"{folder}/data").collect()} == {3}
    assert sum(len(files) for _, _, files in os.walk(f"{folder}/scratch")) < 200


def test_lookup_equals_plain_search(spark):
    """Random names and wanted texts: the parts offered are all that any search inside the names could find."""
    import random

    from trailmark.operators import memory as M

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab1-_.") for _ in range(rng.randint(1, n)))
    files = [(f"q{i % 3}", rng.choice(["memory", "attempt_2", "attempt_10"]), word(9) + f"~{i}", word(3)) for i in range(60)]
    asked = sorted({(f"q{i % 3}", word(4)) for i in range(90)})
    rank = {"memory": 0, "attempt_2": 1, "attempt_10": 2}
    want = {}
    for q, w in asked:
        hits = []
        for fq, folder, stem, inner in files:
            compact = w.replace("-", "")
            kind = 1 if stem.endswith(w) else 2 if compact and stem.endswith(compact) else 3 if w in stem or inner == w else None
            if fq == q and kind:
                hits.append((rank[folder], kind, stem))
        if hits:
            want[q, w] = min(hits)[1:]
    f = spark.createDataFrame(files, "question_id string, folder string, stem string, memory_id string")
    got = {(r.question_id, r.wanted): (r.match, r.stem) for r in M.lookup(spark.createDataFrame(asked, "question_id string, wanted string"), f).collect()}
    assert got == want


def test_strict_lines_name_the_first_bad_line(spark):
    lines = spark.createDataFrame([("f.jsonl", 1, '{"a": 1}'), ("f.jsonl", 2, " "), ("f.jsonl", 3, "{bad")], "path string, line long, text string")
    with pytest.raises(Exception, match="Invalid JSON in f.jsonl:3"):
        IN.strict_records(lines).collect()


def test_lookup_is_the_same_with_few_and_many_folder_names(spark, monkeypatch):
    """Ranks by name where names are few, per row otherwise; the runs of a name stand once, whatever the number of shapes."""
    from trailmark.operators import memory as M

    files = [("q", f, s, i) for f in (None, "attempt_10_x/memory", "attempt_9_x/memory", "memory") for s, i in (("m-1-22", "a"), ("snap-m122", "b"), ("", "c"), (None, "m-1-2"), ("é-m-1-22.json", "d"), ("m-1-222", "e"))]
    snaps = spark.createDataFrame(files, "question_id string, folder string, stem string, memory_id string")
    asked = spark.createDataFrame([("q", w) for w in ("m-1-22", "m122", "m-1-2", "22", "-", "é", "none", "")], "question_id string, wanted string")
    few = sorted(map(str, M.lookup(asked, snaps).collect()))
    monkeypatch.setattr(M, "FEW_NAMES", 0)
    assert sorted(map(str, M.lookup(asked, snaps).collect())) == few and len(few) == 6
    runs = spark.createDataFrame([("m-12é",)], "t string").select(F.explode(M._runs(M._classes(F.col("t"))))).select("col.*").collect()
    assert [tuple(r) for r in runs] == [("a", 1, 1), ("-", 2, 2), ("a", 3, 4), ("-", 5, 5)]
