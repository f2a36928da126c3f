import pytest

#: Texts with every awkward trait: null, empty, blank, repeated, one very long word, one very long line, other scripts.
LINE = "the quick brown fox jumps over the lazy dog near the river bank today"
AWKWARD = [
    None,
    "",
    " \n\t\n ",
    LINE,
    LINE,
    LINE + "\n" + LINE.upper() + "!\n\nshort",
    "x" * 200_000,
    ("long words of one line " * 20_000).strip(),
    "ünïcödé 文字列の例 नमस्ते 🙂 \x00\x01 \x1f end",
    "a",
]


@pytest.fixture()
def awkward(spark):
    """Documents with nulls in every column, repeated ids and rows, and extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s0", len(t or ""), "x", 1.0, 7) for i, t in enumerate(AWKWARD)]
    rows += [rows[3], (None, LINE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (77, LINE, None, "s1", None, None, None, None), (77, "other text of the same id", "de", None, 3, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, component long")


@pytest.fixture()
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture()
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
