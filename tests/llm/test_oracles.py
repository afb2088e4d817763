"""Corpus queries that have SQL agree with DuckDB over the smallest shared tables; the others return a row for what they judge."""

from pathlib import Path

import pytest

from slidespark.llm import queries as Q

from ..differential import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the shared tables are not here")
ONE_EACH = {"op3_html_min_cut": "pages", "op6_line_crf": "documents", "op7_toxicity": "documents", "op8_order_minhash": "documents", "op9_hidden_markov_lm": "documents"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees(spark, name):
    assert compare(Q.queries()[name](spark, SF), connect(SF), Q.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(ONE_EACH))
def test_a_row_each(spark, name):
    assert Q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{ONE_EACH[name]}.parquet").count()
