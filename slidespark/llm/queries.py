"""The corpus operators as queries over the shared tables, one ``opN_`` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, hmm_lm, html_extract, mixing, order_minhash, quality, suffix_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _on2(table: str, other: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.read.parquet(f"{sf_dir}/{other}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_repair": _on("conversations", chat.digest),
        "op2_decontaminate": _on2("documents", "benchmark", decontam.digest),
        "op3_html_min_cut": _on("pages", html_extract.digest),
        "op4_url_link_graph": _on("pages", url_filter.digest),
        "op5_suffix_array_dedup": _on("documents", suffix_dedup.digest),
        "op6_line_crf": _on2("documents", "labels", quality.digest),
        "op7_toxicity": _on2("documents", "labels", toxicity.digest),
        "op8_order_minhash": _on("documents", order_minhash.digest),
        "op9_hidden_markov_lm": _on("documents", hmm_lm.digest),
        "op10_mix_sources": _on("documents", mixing.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_repair": chat.oracle(), "op4_url_link_graph": url_filter.oracle(), "op5_suffix_array_dedup": suffix_dedup.oracle(), "op10_mix_sources": mixing.oracle()}
