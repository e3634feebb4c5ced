"""The queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from funnelwright.llm import alignment, bpe, chat, decontaminate, fuzzy, periods, pii, quality, records, sharding, simhash, toxicity, urls
from funnelwright.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
# Operator 13. The rules of its contract, and a blocklist of site names as an example of the list a filter is given.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URL_LISTED = [(f"{name}.example.{top}", "/", "block") for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for top in ("com", "net", "org")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return records.read_records(records.write_records(docs, public_tokenizers.path(BYTE_BPE)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans_of(table(spark, sf_dir, "documents")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.assign(table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.digests(fuzzy.with_next(table(spark, sf_dir, "documents")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digests(toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(periods.with_repeats(table(spark, sf_dir, "documents"))))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.digests(alignment.align(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = (urls.build(spark.createDataFrame(r, "host string, path string, verdict string")) for r in (URL_RULES, URL_LISTED))
    return urls.judge(table(spark, sf_dir, "pages"), rules, listed)


def _values(rules: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)


OP13_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
own AS (SELECT DISTINCT host, path FROM parts),
rules AS (SELECT * FROM (VALUES {_values(URL_RULES)}) AS r(rh, rp, rv)),
listed AS (SELECT * FROM (VALUES {_values(URL_LISTED)}) AS r(rh, rp, rv)),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM own JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2),
held AS (SELECT DISTINCT host, path FROM own JOIN listed ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, p.host, p.path, rule, coalesce(rv, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN held h ON p.host = h.host AND p.path = h.path
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_binary_records": op1,
    "op2_personal_data": op2,
    "op3_balanced_shards": op3,
    "op4_decontamination": op4,
    "op5_role_repair": op5,
    "op6_piecewise_hashes": op6,
    "op7_pair_index_bpe": op7,
    "op8_rule_ensemble_quality": op8,
    "op9_simhash_components": op9,
    "op10_sentence_toxicity": op10,
    "op11_periodic_runs": op11,
    "op12_span_alignment": op12,
    "op13_url_rules": op13,
}
ORACLES: dict[str, str] = {"op13_url_rules": OP13_SQL}
