"""The queries of the text operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, contamination, fingerprint, langid, minhash, packing, pii, quality, spelling, suffix, toxicity, trie_dedup, turns
from .common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark), count_col="n_values")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_digest(read(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(read(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_pii": op2_pii,
        "op3_fingerprints": op3_fingerprints,
        "op4_language": op4_language,
        "op5_near_dedup": op5_near_dedup,
        "op6_bpe": op6_bpe,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_repeats": op10_repeats,
        "op11_conversations": op11_conversations,
        "op12_spelling": op12_spelling,
        "op13_decontamination": op13_decontamination,
    }


#: A-Z only, as the contract has it.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Runs of everything but ASCII characters other than digits and lower-case letters.
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
        with d as (select cast(doc_id as bigint) as doc_id, {_FOLD} as body from documents)
        select doc_id, max(doc_id) over (partition by body) as keep_id,
               count(*) over (partition by body) as group_size,
               doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from d""",
    "op13_decontamination": f"""
        with b as (select cast(item_id as varchar) as item_id, regexp_extract_all({_FOLD}, {_WORDS}) as w from benchmark),
        windows as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
          from (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
        d as (select doc_id, regexp_extract_all({_FOLD}, {_WORDS}) as w from documents),
        places as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
          from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join (select distinct k from windows))),
        hit as (select doc_id, i, k, item_id from places join windows using (k, g)),
        covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, item_id from hit) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join covered using (doc_id) left join items using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
