"""Every engine query against its SQL, on the smallest tables."""

import pytest

import oracle
from wordloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert oracle.compare_with(spark, name, SF, QUERIES[name], ORACLE_SQL[name]).startswith("equal")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_tag_repair_takes_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '\\S'")
    assert docs.where("lang is null or lang <> 'en'").count() > 0
    assert QUERIES["tag_repair"](spark, SF).count() == docs.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
