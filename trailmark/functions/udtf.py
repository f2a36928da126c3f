"""Table functions for SQL users; they run per row inside tasks on what the query hands them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from trailmark.functions import scalars as S
from trailmark.functions import tables as X


def _lines(response: str) -> list[list[str]] | None:
    """Stripped cells of the content lines of the table in a text; None without a table."""
    fenced = re.search(X.FENCED_TABLE, response)
    if fenced:
        block = fenced.group(1)
    elif response.count("|") >= X.MIN_PIPES:
        first, *rest = response[response.index("|") :].split("\n")
        follow = next((i for i, line in enumerate(rest) if not line.startswith("|")), len(rest))
        block = "\n".join([first, *rest[:follow]])
    else:
        return None
    breaks = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), X.LINE_BREAK)
    lines = [line.strip(S.WHITESPACE) for line in re.split(breaks, block.strip(S.WHITESPACE))]
    kept = [line for line in lines if "|" in line and not re.search(X.SEPARATOR_LINE.replace("$", r"\Z"), line)]
    return [[cell.strip(S.WHITESPACE) for cell in line.split("|")] for line in kept]


class TableRows:
    """Rows of the first table in a text: ``row_id`` and ``cells``, a map from column name to text.

    As ``tablematch.table_rows(extract_tables(...))``: a text without a usable table, with a row wider than its header or with two
    columns of one name has no rows.
    """

    def eval(self, response: str) -> Iterator[tuple[int, dict[str, str | None]]]:
        lines = _lines(response or "")
        if not lines or len(lines) < 2:
            return
        header, *body = lines
        names = [cell.strip(S.WHITESPACE).lower().replace(" ", "") for cell in header]
        named = [n for n in names if n]
        if not named or len(set(named)) < len(named) or any(len(line) > len(header) for line in body):
            return
        for row_id, line in enumerate(body):
            yield row_id, {n: line[i] if i < len(line) else None for i, n in enumerate(names) if n}


def register(spark: SparkSession) -> None:
    """Make ``table_rows(text)`` known to SQL: ``SELECT ... FROM responses, LATERAL table_rows(response)``."""
    spark.udtf.register("table_rows", udtf(TableRows, returnType="row_id bigint, cells map<string,string>"))
