"""Quality by a factorization machine over hashed words, structure statistics and the text's length (see fm)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import fm

MODULUS, REST, THRESHOLD = 5, 0, 0.3


def quality(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3).

    Learns `labels.quality` of at most `sample` rows whose crc32(doc_id) mod 5 is not 0; null labels and
    ids are skipped. Null and empty texts are scored by their structure features alone. Repeated rows
    are scored each; an empty table of documents gives no rows; without labels the score is 0.5.
    """
    return fm.scores(docs, fm.fit(docs, labels, "quality", MODULUS, REST, sample, 1e-4), MODULUS, REST, THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """The rows of `docs` that `quality` predicts 1 for, with all their columns. Null texts are scored as empty ones;
    repeated rows share their score, so they stay or go together; an empty table gives an empty one."""
    return fm.keep_rows(docs, fm.fit(docs, labels, "quality", MODULUS, REST, sample, 1e-4), THRESHOLD)
