"""Toxicity by a factorization machine over hashed terms (see fm)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import fm

MODULUS, REST, THRESHOLD = 3, 1, 0.7


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7).

    Learns `labels.toxic` of at most `sample` rows whose crc32(doc_id) mod 3 is not 1; null labels and
    ids are skipped. Null and empty texts are scored by their structure features alone. Repeated rows
    are scored each; an empty table of documents gives no rows; without labels the score is 0.5.
    """
    return fm.scores(docs, fm.fit(docs, labels, "toxic", MODULUS, REST, sample, 3e-5), MODULUS, REST, THRESHOLD)
