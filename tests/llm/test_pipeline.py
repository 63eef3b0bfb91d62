"""Each stage against its plain definition on its own input."""

import hashlib
import re

import corpus_pipeline as cp
from conftest import SMALL
from roadloom.llm import queries
from roadloom.llm.common import read, stage
from test_minhash import brute


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    good = {r["doc_id"] for r in queries.op8_quality(spark, SMALL).where("predicted = 1").collect()}
    steps = []
    for name, f in cp.STAGES:
        docs = stage(f(spark, docs, SMALL), name)
        steps.append(docs)
    a, b, c, d, e = (s.toPandas() for s in steps)
    assert set(a.doc_id) == good and all(list(x.columns) == list(a.columns) for x in (b, c, d))
    low = lambda t: hashlib.sha256("".join(x.lower() if "A" <= x <= "Z" else x for x in t).encode()).hexdigest()
    assert set(b.doc_id) == set(a.groupby(a.text.map(low)).doc_id.max()) and len(b) == b.doc_id.nunique()
    want = brute(list(zip(b.doc_id, b.text)))
    assert sorted(c.doc_id) == sorted(i for i, (_, _, kept) in want.items() if kept)
    assert list(sorted(d.doc_id)) == list(sorted(c.doc_id)) and (d.n_chars == d.text.str.len()).all()
    before, after = c.set_index("doc_id").text, d.set_index("doc_id").text
    found = re.compile(r"[\w.]+@mail[\w.]*")
    named = [i for i in before.index if found.search(before[i])]
    assert named and all(not set(found.findall(before[i])) & set(found.findall(after[i])) for i in named)
    plain = [i for i in before.index if not re.search(r"[0-9@]|(?i:token|secret|pass|key)", before[i])]
    assert plain and (before[plain] == after[plain]).all()
    assert set(e.doc_id) == set(d.doc_id) and e.groupby("sequence_id").length.sum().max() <= 2048
    assert e.sequence_id.nunique() <= -(-e.length.sum() // 2048) * 1.02 + 1


def test_odd_rows_and_names(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names and empty tables through all stages."""
    labels = read(spark, SMALL, "labels")
    text = read(spark, SMALL, "documents").where("length(text) between 500 and 2000").orderBy("doc_id").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, of int, by string, parts int, sketch string"
    rows = [(1, text, "en", "a", 3, 1, "x", 1, None), (1, text, "en", "a", 3, 1, "x", 1, None), (2, None, None, None, None, None, None, None, None), (3, "", None, "b", 0, 2, None, 2, "s"), (None, text.upper(), None, None, 1, 3, "y", 3, None), (4, text + " more words at the end", "en", "c", 1, 4, "z", 4, None)]
    for some in (rows, []):
        docs, kept = spark.createDataFrame(some, schema), None
        labels.limit(10_000).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        for name, f in cp.STAGES:
            docs = stage(f(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            kept = docs.count()
            assert (kept == 0) == (not some) or name == "quality"
            if name == "exact_dedup":
                assert docs.where("doc_id = 1").count() <= 1
