"""Deduplication decides by row: ids may be repeated or missing."""

from trailmark.llm import linededup, simhash

ONE = "the quick brown fox jumps over the lazy dog near the river bank today"
TWO = "an entirely different sentence that speaks of ships and harbours at dawn"
THREE = "nothing in common with either of them, only numbers such as one and nine"
ROWS = [(5, ONE), (5, ONE), (7, ONE), (7, TWO), (None, TWO), (None, TWO), (None, THREE), (None, THREE)]


def texts(found):
    return sorted((str(r.doc_id), r.text) for r in found.collect())


def test_lines_are_cut_by_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert texts(linededup.drop_repeated_lines(docs, by_row=True)) == sorted([("5", ONE), ("5", ""), ("7", ""), ("7", TWO), ("None", ""), ("None", ""), ("None", THREE), ("None", "")])


def test_one_row_of_a_group_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert texts(simhash.keep_one_row(docs)) == sorted([("5", ONE), ("7", TWO), ("None", THREE)])
    assert simhash.keep_one_row(docs.limit(0)).count() == 0
