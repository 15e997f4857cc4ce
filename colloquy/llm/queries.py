"""The queries of this subpackage: name -> (spark, directory of tables) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import encode, formatting, language, leaks, overlap, pairs, personal, sentences
from colloquy.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "chat_logs"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return personal.cleaned(table(spark, d, "chat_logs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "faqs_cardiovascular"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.ids_of(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "intents"), table(spark, d, "eval_queries"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "intents"), table(spark, d, "eval_queries"))


def p1_covered(spark: SparkSession, d: str) -> DataFrame:
    return overlap.covered(table(spark, d, "intents"), table(spark, d, "eval_queries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "intents"), table(spark, d, "chat_logs"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.labelled(table(spark, d, "intents"), table(spark, d, "chat_logs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.found(table(spark, d, "intents"), table(spark, d, "eval_queries"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return formatting.counts(table(spark, d, "intents"), table(spark, d, "eval_queries"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(p8_found(spark, d), table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p1_covered": p1_covered, "p2_found": p2_found, "p2_segments": p2_segments, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_cleaned": p4_cleaned, "p5_found": p5_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found}


# SQL without compatibility normalisation: of the compatibility forms only full-width ones are folded, which is what the
# tables have. Edit distances over words, hashes of JSON objects and learnt models are beyond it.
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_PLAIN_WORDS = f"regexp_extract_all(strip_accents(lower(regexp_replace(translate(text, '{_WIDE}', '{_PLAIN}'), '\\p{{Cf}}', '', 'g'))), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
_WINDOWS = lambda key, of: f"select {key}, array_to_string(w[k:k + 11], ' ') as s from (select {key}, w, unnest(generate_series(1, len(w) - 11)) as k from {of} where len(w) >= 12)"
_P8 = f"""with d as (select distinct doc_id, {_PLAIN_WORDS} as w from documents where doc_id is not null and text is not null), i as (select distinct item_id, {_PLAIN_WORDS} as w from eval_passages where item_id is not null and text is not null),
iw as (select distinct * from ({_WINDOWS("item_id", "i")})), dw as ({_WINDOWS("doc_id", "d")}), found as (select distinct doc_id, item_id from dw join iw using (s))"""


def oracle_sql() -> dict[str, str]:
    sources = "(select doc_id, coalesce(min(source), '') as source from documents group by doc_id)"
    return {"p8_found": f"{_P8} select doc_id, item_id from found", "p8_report": f"{_P8} select item_id, source, count(distinct doc_id) as n_docs from found join {sources} using (doc_id) group by all"}
