"""Registered queries of the subpackage, one per operator, with their SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from propensa.llm import (
    bpe, chat, decontaminate, jaccard, negatives, pages, quality, secrets, substring, suffixes, topk, toxicity, trie
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.digest(substring.substring_dedup(docs))


@query("op2_jaccard_join")
def op2(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_chat_formatting")
def op3(spark, sf_dir):
    return chat.digest(chat.format_chats(table(spark, sf_dir, "conversations")))


@query("op4_bpe_encode_decode")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.encode(docs, bpe.default_ranks(), full=False))


@query("op5_quality_rules", quality.ORACLE)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.measured_cascade(docs))


@query("op6_html_extraction")
def op6(spark, sf_dir):
    return pages.digest(pages.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"]))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.digest(suffixes.suffix_dedup(docs))


@query("op8_decontaminate")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op11_conversation_trie", trie.ORACLE)
def op11(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_exact_top_k", topk.ORACLE)
def op12(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", negatives.ORACLE)
def op13(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
