"""Caller-supplied Python functions over request tables.

The functions run inside tasks on Arrow batches; the number of partitions of the request table bounds how
many run at once. Parsing what they return stays in native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])


def call_function(requests: DataFrame, fn: Callable[..., str], arguments: list[str], max_attempts: int = 3) -> DataFrame:
    """Call ``fn(**arguments)`` per row; adds output, attempts and the last error as data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outs, tries, errors = [], [], []
            for row in batch[arguments].to_dict("records"):
                out = err = None
                for attempt in range(1, max(max_attempts, 1) + 1):
                    try:
                        out, err = fn(**row), None
                        break
                    except Exception as exc:  # noqa: BLE001
                        err = f"{type(exc).__name__}: {exc}"
                outs.append(out), tries.append(attempt), errors.append(err)
            yield batch.assign(output=outs, attempts=tries, error=errors)

    schema = _with_fields(requests, ("output", T.StringType()), ("attempts", T.IntegerType()), ("error", T.StringType()))
    return requests.mapInPandas(run, schema)


def ask_until_parseable(
    requests: DataFrame, ask: Callable[[str], str], parseable: Callable[[str], bool], max_attempts: int = 3
) -> DataFrame:
    """Ask per request text until a reply parses; the last reply is kept when none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, tries, errors = [], [], []
            for text in batch["request"]:
                reply = err = None
                for attempt in range(1, max(max_attempts, 1) + 1):
                    try:
                        reply, err = ask(text) or "", None
                    except Exception as exc:  # noqa: BLE001
                        err = f"{type(exc).__name__}: {exc}"
                        continue
                    if parseable(reply):
                        break
                replies.append(reply), tries.append(attempt), errors.append(err if reply is None else None)
            yield batch.assign(reply=replies, attempts=tries, call_error=errors)

    schema = _with_fields(requests, ("reply", T.StringType()), ("attempts", T.IntegerType()), ("call_error", T.StringType()))
    return requests.mapInPandas(run, schema)


def estimate_tokens(messages: DataFrame, by: list[str], count: Callable[..., pa.Array], columns: list[str], finish: Callable[[Column], Column] = lambda total: total) -> DataFrame:
    """Tokens per group by a caller's estimator: ``count`` maps Arrow columns to a number per message, ``finish`` their sum.

    The counts are summed before they are shuffled, so a group of any size sends one number per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = count(*[batch.column(c) for c in columns])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], counted.cast(pa.int64())], names=[*by, "tokens"])

    keys = messages.select(*by).schema.fields
    counted = messages.select(*dict.fromkeys([*by, *columns])).mapInArrow(run, T.StructType([*keys, T.StructField("tokens", T.LongType())]))
    return counted.groupBy(*by).agg(finish(F.sum("tokens")).cast("bigint").alias("tokens"))
