"""Work that takes long per row is dealt over all cores, whatever the row groups of the files."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from exposure.functions import extract, text
from exposure.operators.joins import spread
from exposure.params import Gate
from exposure.sources import vault
from queries.catalog import QUERIES, full_rescan_sources

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["json_candidates", "vault_items", "vault_detect"])
def test_one_row_group_is_read_by_many_tasks(spark, name):
    df = QUERIES[name](spark, SF)
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) >= spark.sparkContext.defaultParallelism and max(n) < 0.2 * sum(n)


def test_equal_rows_are_dealt_evenly(spark):
    n = [r["count"] for r in spread(spark.range(8000).select(F.lit(1).alias("k"))).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 8000 and max(n) < 1000


def test_json_values_of_just_enough_bytes(rows):
    cases = {
        '{"password":"abcdefgh"}': ["abcdefgh"],
        '{"password":"\\u0061bcdefgh"}': ["abcdefgh"],
        '{"password":"äöüß"}': ["äöüß"],
        '{"password":"abcdefg"}': [],
        '{"password":"\\u0061bcdefg"}': [],
        '{"k": 76}': [],
        '{"password":"abcdefgh"': [],
        "[]": [],
    }
    got = rows([(t,) for t in cases], "t string", "t", extract.from_json_text(F.col("t")))
    assert {t: c for t, c in got} == cases


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listings_are_parsed_where_rows_are_dealt_to(spark):
    listings = spread(spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_name").alias("items")))
    assert "variant" not in plan(vault.invalid(listings)).split("REPARTITION_BY_NUM")[1]


def test_errors_of_a_rescan_read_no_texts(spark):
    assert "text:string" not in plan(full_rescan_sources(spark, SF)[0].errors)


def test_errors_of_a_rescan_are_counted_once(spark):
    df = QUERIES["rescan_from_corpus"](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # Documents as old registry, as env files and as errors: each once.
    assert final.count("/documents.parquet") == 3


def test_entropy_of_long_strings(rows):
    texts = ["ab" * 200 + "cdé" * 70 + "\U0001f600" * 9, "x" * 256 + "y", "x" * 255 + "yz", "ab", "a" * 300]

    def bits(t):
        n = len(t.encode())
        return -sum(k / n * math.log2(k / n) for k in Counter(t).values())

    distinct = F.expr(text.has_distinct_sql("t", 3))
    got = rows([(t,) for t in texts], "t string", "t", text.entropy(F.col("t")), distinct)
    assert all(e == pytest.approx(bits(t), abs=1e-8) and d == (len(set(t)) >= 3) for t, e, d in got)


def test_short_pieces_do_not_pass_after_cutting(rows):
    secret = "0123456789abcdefABCDEF0123456789"
    got = rows([(f"K={secret} J={secret[1:]}",)], "t string", extract.candidates(F.col("t"), Gate(32, 3.0)))
    assert secret in got[0][0] and secret[1:] not in got[0][0]
