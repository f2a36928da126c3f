"""Tables written inside text: picking the block and splitting it into header and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import scalars as S

# ---- fixed values -------------------------------------------------------------------------
FENCED_TABLE = r"(?is)```markdown(.*?)```"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SEPARATOR_LINE = r"^[|\- :]*$"
MIN_PIPES = 4
MISSING = "nan"
# texts a CSV reader takes for a missing value
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
# -------------------------------------------------------------------------------------------


def cell_text(c: Column) -> Column:
    """Cell as compared later: every way to write a missing value becomes ``nan``."""
    return F.when(c.isNull() | c.isin(*MISSING_TEXTS), F.lit(MISSING)).otherwise(c)


def pipe_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def first_pipe_block(text: Column) -> Column:
    """From the first pipe to its line end, plus directly following lines that start with a pipe."""
    lines = F.split(F.substr(text, F.locate("|", text)), "\n")
    head = F.get(lines, F.lit(0))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda line: line.startswith("|")), F.lit(False))
    follow = F.when(stop == 0, rest).otherwise(F.slice(rest, F.lit(1), (stop - 1).cast("int")))
    return F.array_join(F.concat(F.array(head), follow), "\n")


def table_block(text: Column) -> Column:
    """Text of the first tagged fence, else of the first pipe block; null without a table."""
    fenced = F.get(F.regexp_extract_all(text, F.lit(FENCED_TABLE), F.lit(1)), F.lit(0))
    return F.coalesce(fenced, F.when(pipe_count(text) >= MIN_PIPES, first_pipe_block(text)))


def table_lines(block: Column) -> Column:
    """Cell arrays of the content lines: no blank, pipe-less or separator lines."""
    lines = F.transform(F.split(S.strip(block), LINE_BREAK), S.strip)
    kept = F.filter(lines, lambda line: F.contains(line, F.lit("|")) & ~line.rlike(SEPARATOR_LINE))
    return F.transform(kept, lambda line: F.transform(F.split(line, r"\|"), S.strip))


def csv_records(text: Column) -> Column:
    """Records of a CSV text; quoted cells may hold commas, doubled quotes and line breaks."""
    whole = F.regexp_extract_all(text, F.lit(r'((?:[^"\r\n]++|"(?:[^"]++|"")*+")++)'), F.lit(1))
    kept = F.filter(whole, lambda r: ~S.is_blank(r))
    return F.transform(
        kept,
        lambda r: F.transform(
            F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(r',("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1)),
            lambda cell: F.when(
                cell.startswith('"'), F.replace(F.regexp_replace(cell, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
            ).otherwise(cell),
        ),
    )
