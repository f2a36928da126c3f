"""Registered queries against their SQL on small tables made to hold what the given ones rarely do."""

from datetime import datetime

import duckdb

import pytest

import __spark_entry__ as entry
from test_oracles import ordered, plain
from trailmark.catalog import source_cases


def same_as_sql(spark, folder, key, **tables):
    """Write the tables, run the query and its SQL over them, compare all rows and return them."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    df = entry.queries()[key](spark, folder)
    cols = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    want = ordered([tuple(plain(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[key]}) q").fetchall()])
    assert got == want and got
    return got


LINEITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"


def line(orderkey, number=1, price=10.5, flag="A", quantity=3.0, part=1, supp=0):
    return (orderkey, part, supp, number, quantity, price, flag, datetime(1996, 9, 13))


def test_id_sums_beyond_64_bits(spark, folder):
    rows = [line(9_000_000_000 + i) for i in range(6)] + [line(9_000_000_000, price=10.6)]
    same_as_sql(spark, folder, "tm4_first_row_per_key", lineitem=spark.createDataFrame(rows, LINEITEM))


TWICE = [line(5, flag="A", quantity=3.0), line(5, flag="N", quantity=9.0, part=11), line(5, number=2), line(6, part=17), line(7, part=23), line(7, part=13)]


def test_exact_match_of_ids_that_occur_twice(spark, folder):
    assert len(same_as_sql(spark, folder, "fn6_exact_match", lineitem=spark.createDataFrame(TWICE, LINEITEM))) == 3


def test_number_near_of_ids_that_occur_twice(spark, folder):
    assert len(same_as_sql(spark, folder, "fn8_number_near", lineitem=spark.createDataFrame(TWICE, LINEITEM))) == 3


EVENTS = "event_id bigint, user_id bigint, event_type string, value double, props string"


def blank_and_absent_arguments(spark):
    """Calls of one run whose arguments are a number field's worth, null (no fields) and blank, in an order that looks like a cycle."""
    a, null, blank = [i for i in range(8, 2000, 4) if i % 73 and all(i % m for m in (79, 83, 89, 101, 103, 107, 109))], 107 * 4, 109 * 4
    marks = [i for i in a if i < null][-1:] + [null] + [i for i in a if null < i < blank][-1:] + [blank] + [i for i in a if i > blank][:1]
    return spark.createDataFrame([(i, 1, "view", 1.0, '{"k": 1}') for i in marks], EVENTS)


def test_loop_detection_tells_blank_arguments_from_none(spark, folder):
    assert {r[0] for r in same_as_sql(spark, folder, "win4_loop_detection", events=blank_and_absent_arguments(spark))} == {None}


def test_loop_guard_tells_blank_arguments_from_none(spark, folder):
    assert {r[0] for r in same_as_sql(spark, folder, "str5_loop_guard", events=blank_and_absent_arguments(spark))} == {None}


@pytest.mark.parametrize("key", ["src10_review_lines", "src11_review_files"])
def test_logs_joined_from_ranges_sorted_apart(spark, folder, monkeypatch, key):
    monkeypatch.setattr(source_cases, "SORTED_TOGETHER", 7)  # the lines of a file come from many ranges
    events = spark.createDataFrame([(i, i % 5, "view", 1.0, f'{{"k": {i % 100}}}') for i in range(300)], EVENTS)
    assert len(same_as_sql(spark, folder, key, events=events)) == (300 if key == "src10_review_lines" else 6)


@pytest.mark.parametrize("key", ["fn6_exact_match", "fn8_number_near"])
def test_scores_of_absent_values(spark, folder, key):
    absent = [line(5, flag=None, quantity=None), line(6, price=None), line(7, price=None, part=23), line(8, flag=None), line(9, quantity=None, part=11)]
    assert len(same_as_sql(spark, folder, key, lineitem=spark.createDataFrame(absent, LINEITEM))) == 4
