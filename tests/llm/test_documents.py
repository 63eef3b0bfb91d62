"""Operators against brute force, round trips and held-out accuracy; odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from conftest import SMALL
from roadloom.llm import bpe, fingerprint, fm, langid, packing, quality, queries, toxicity, trie_dedup

SCHEMA = "doc_id long, text string, lang string, keep_id int, h1 string"
WORDS = ["alpha", "Beta", "gamma", "ÉTÉ", "ß", "don't", "x1", "٣½²", "Σίσυφος", "á", "Ά", "it's", "!!", "naïve", "İstanbul", "日本語", "e\x1cf", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "😀"]


def odd_docs():
    rng = random.Random(2)
    rows = [(None, None, None, 1, "x"), (None, "", "en", 2, "y"), (1, "Ab", "de", 3, "z"), (2, "aB", None, 4, "z"), (3, "aB", "fr", 5, None), (3, "aB", "fr", 5, None), (4, "É", "fr", 6, ""), (5, "é", "fr", 7, "")]
    rows += [(6 + i, "".join(rng.choice(WORDS) + rng.choice([" ", "", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), i, "") for i in range(40)]
    return [*rows, (900, "long " * 300_000, "en", 0, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(odd, none, spark, monkeypatch):
    groups = {}
    for r in odd_docs():
        groups.setdefault(fold(r[1]), []).append(r[0])
    want = sorted((str(r[0]), str(max((i for i in groups[fold(r[1])] if i is not None), default=None)), len(groups[fold(r[1])]), hashlib.sha256(fold(r[1]).encode()).hexdigest()) for r in odd_docs())
    for limit in (trie_dedup.TASK_TRIE_BYTES, 10):
        monkeypatch.setattr(trie_dedup, "TASK_TRIE_BYTES", limit)
        got = trie_dedup.exact_dedup(odd).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    assert trie_dedup.exact_dedup(none).count() == 0
    left = trie_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_trie():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(3000)]
    trie, seen = trie_dedup.PatriciaTrie(), {}
    for k in keys:
        node = trie.find(k)
        assert seen.setdefault(k, node) is node
    assert len({id(n) for n in seen.values()}) == len(seen)


def test_fingerprints(odd, none, spark):
    rows = sorted(odd_docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for bits in (128, 3):
        got = {}
        for r in fingerprint.fingerprints(odd, bits=bits, partitions=5).collect():
            got.setdefault(r["doc_id"], []).append(r)
        whole = {}
        for k, row in enumerate(rows):
            t, n = row[1] or "", rows[(k + 1) % len(rows)][1] or ""
            q = len(t) // 4
            e = t[: len(t) - q] + n[:q]
            same, kept = float(fingerprint.canonical(t) == fingerprint.canonical(n)), float(fingerprint.canonical(t) == fingerprint.canonical(e))
            assert any((r["n_chars"], r["edited_sha256"], r["near_next"], r["near_edited"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), same, kept) for r in got[row[0]])
            whole.setdefault(fingerprint.canonical(t), set()).update(r["fingerprint"] for r in got[row[0]] if len([x for x in rows if x[0] == row[0]]) == 1)
        prints = [next(iter(v)) for v in whole.values() if v]
        assert all(len(v) <= 1 for v in whole.values()) and len(set(prints)) == len(prints)
    assert fingerprint.fingerprints(none).count() == 0


def test_fingerprints_of_table(spark):
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, SMALL).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    for k, (i, t) in enumerate(docs):
        e = fingerprint.edited(t, docs[(k + 1) % len(docs)][1])
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[i]["fingerprint"] == fingerprint.digest(fingerprint.canonical(t)) and got[i]["edited_fingerprint"] == fingerprint.digest(fingerprint.canonical(e))


def encoded(path):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(path), []
    for r in odd_docs():
        e = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), e, t.decode(e, skip_special_tokens=False)))
    return want


def test_bpe(odd, none, spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r[0]), r[1], r[2]) for r in bpe.encode(odd, path).collect()) == sorted(encoded(path))
    want = [(i, len(e), sha(" ".join(map(str, e))), sha(d)) for i, e, d in encoded(path)]
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encode_digest(odd, path).collect()) == sorted(want)
    assert bpe.encode_digest(none, path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd, queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("words,refs,gathered", [(3, 1 << 20, 4), (200_000, 10, 1), (200_000, 1 << 20, 500_000)])
def test_bpe_chunks(monkeypatch, words, refs, gathered):
    """The steps one by one, with chunks and gathered rows of any size."""
    import pyarrow as pa

    for name, value in (("CHUNK_WORDS", words), ("CHUNK_REFS", refs), ("ROW_REFS", refs // 2), ("GATHERED", gathered)):
        monkeypatch.setattr(bpe, name, value)
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = [(r[0], r[1]) for r in odd_docs()]
    source = [pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs[lo : lo + 3]], pa.int64()), "text": pa.array([d[1] for d in docs[lo : lo + 3]], pa.string())}) for lo in range(0, len(docs), 3)]
    words, texts = ([r for b in bpe._split(iter(source), path, spoken) for r in b.to_pylist()] for spoken in (True, False))
    assert {r["chunk"] for r in words} <= {r["chunk"] for r in texts}
    met = sorted((r["word"], r["chunk"], r["at"]) for r in words)
    assert all(r["refs"] is not None for r in texts)
    batches = [pa.RecordBatch.from_pydict(dict(zip(("word", "chunk", "at"), map(list, zip(*met[lo : lo + 5]))))) for lo in range(0, len(met), 5)]
    back = [tuple(r.values()) for b in bpe._encode_words(iter(batches), path) for r in b.to_pylist()]
    back += [(r["chunk"], True, r["ids"], r["sizes"], r["refs"], None, None, None) for r in texts]
    back.sort(key=lambda r: r[:2])
    types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    joined = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*back[lo : lo + 4]), types)], names=list("abcdefgh")) for lo in range(0, len(back), 4)]
    got = [(str(r["doc_id"]), r["ids"], r["decoded"]) for b in bpe._join_back(iter(joined), path) for r in b.to_pylist()]
    assert sorted(got) == sorted(encoded(path))


def test_bpe_numbers():
    import numpy as np

    for numbers in ([], [0, 5], [0xFFFF, 0x10000, 3, 4_000_000, (1 << 24) - 1]):
        assert bpe.expanded(bpe.squeezed(np.array(numbers, np.uint32))).tolist() == numbers


def check_packing(rows, texts, path, most=2048):
    from tokenizers import Tokenizer

    t, by = Tokenizer.from_file(path), {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    for i, text in texts:
        e, start = t.encode(text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]):
            assert (r["start"], zlib.crc32(np.array(e[start : start + r["length"]], "<u4").tobytes())) == (start, r["ids_crc32"])
            start += r["length"]
        assert start == len(e)
    assert len(by) <= -(-sum(r["length"] for r in rows) // most) * 1.02 + 1


def test_packing(odd, none, spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    ids = [r[0] for r in odd_docs()]
    once = odd.where("doc_id is not null and doc_id <> 3")
    check_packing(packing.pack(once, path).collect(), [(r[0], r[1]) for r in odd_docs() if ids.count(r[0]) == 1], path)
    assert packing.pack(odd, path).select("sequence_id", "offset").distinct().count() == packing.pack(odd, path).count()
    assert packing.pack(none, path).count() == 0


def test_packing_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_packing(queries.op9_packing(spark, SMALL).collect(), docs, queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_plan_respects_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 3000)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    cap = packing.Capacity(100, 4, 10_001, rule, (1.0, 0.5, 0.5))
    seqs, seen = {}, {}
    for length, a, b, first, each, offset in packing.plan(histogram, cap).tolist():
        for rank in range(a, b):
            seen.setdefault(length, set()).add(rank)
            seqs.setdefault(first + (rank - a) // each, []).append((offset + (rank - a) % each * length, length))
    assert {k: len(v) for k, v in seen.items()} == histogram
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1])
        assert sum(n for _, n in own) <= 100 and len(own) <= 4 and sum(n * n for _, n in own) <= 10_001


def test_language(odd, none, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    rows = {(r["doc_id"]): r for r in langid.identify(odd.unionByName(spark.createDataFrame([(77, "123 !?", "en", 1, "")], SCHEMA))).collect()}
    assert rows[77]["lang_pred"] == "und" and rows[4]["lang_pred"] in ("de", "en", "fr") and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.identify(none).count() == 0


def plain_ppm(learnt, text):
    """Bits of `text` (bytes) after the texts `learnt`, byte by byte."""
    fold = lambda s: bytes(c + 32 if 65 <= c <= 90 else c for c in s)
    counts = [{} for _ in range(langid.ORDER + 1)]
    for s in learnt:
        s = b" " * langid.ORDER + fold(s)
        for i in range(langid.ORDER, len(s)):
            for k in range(langid.ORDER + 1):
                seen = counts[k].setdefault(s[i - k : i], {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    s, bits = b" " * langid.ORDER + fold(text), 0.0
    for i in range(langid.ORDER, len(s)):
        for k in range(langid.ORDER, -1, -1):
            seen = counts[k].get(s[i - k : i])
            if not seen or (k > 1 and sum(seen.values()) < 2):
                continue
            total, kinds = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits -= np.log2(seen[s[i]] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_language_against_plain_ppm():
    learnt = {"en": [b"the cat sat on the mat, The Hat", b"a theme", b""], "de": ["die Katze saß auf der Matte".encode(), b"der Hut"], "xx": [b"q"]}
    texts = [b"the hat", "die Maße".encode(), b"", b"zzz", b"Q", b"a", b"the cat sat on the mat" * 9]
    trees = []
    for own in learnt.values():
        data, offsets = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        trees.append(langid.Tree(*(x.astype(float) if k else x.astype(np.int64) for k, x in enumerate(np.unique(langid.contexts(data, offsets), return_counts=True)))))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    best, score = langid.score_texts(trees, data, offsets)
    for i, text in enumerate(texts):
        bits = np.array([plain_ppm(own, text) for own in learnt.values()])
        mean = bits / max(len(text), 1)
        assert best[i] == bits.argmin() and abs(score[i] - 2 ** -mean.min() / (2**-mean).sum()) < 1e-9


def test_language_score_tells(spark):
    """The score isn't the same for all texts, and wrong predictions have low ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = [r["score"] for r in langid.identify(docs).collect()]
    assert 0.25 < np.percentile(scores, 5) < np.percentile(scores, 95) < 1 and len(set(scores)) > len(scores) / 4


@pytest.mark.parametrize("name,f,column,modulus,rest", [("toxicity", toxicity.toxicity, "toxic", 3, 1), ("quality", quality.quality, "quality", 5, 0)])
def test_classifiers(odd, none, spark, name, f, column, modulus, rest):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in f(docs, labels).collect()}
    true = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % modulus == rest]
    assert all(got[i]["held_out"] for i in held)
    a, b = (np.array([got[i]["score"] for i in held if true[i] == k]) for k in (1, 0))
    assert np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])) > 0.95
    assert np.mean([got[i]["predicted"] == true[i] for i in held]) > 0.95
    few = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert {0 <= r["score"] <= 1 for r in f(odd, few).collect()} == {True}
    assert {r["score"] for r in f(odd, few.limit(0)).collect()} == {0.5} and f(none, labels).count() == 0


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 2)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    row, feature = np.nonzero(x)
    model = fm.train(y, row, feature * 1000 + 5)
    s = model.margin(row, model.keep[feature * 1000 + 5], len(y)) > 0
    assert (s == (y > 0)).mean() > 0.99 and np.abs(model.factor).max() > 0.1
