"""BPE encoding and decoding through a distinct-word table.

  1. Each task splits its texts into words and numbers the distinct ones of a chunk of texts; a text becomes the
     sequence of its words' numbers, and a distinct word leaves the chunk once.
  2. Words of all chunks meet by word: each distinct word of the corpus is encoded once, and its ids go back to
     the chunks that have it, in one row for each chunk and task.
  3. The numbered texts meet their chunk's ids and put them back by position; the ids are decoded by a join with
     the id-to-piece table, which is as large as the tokenizer file and is looked up in the task.
Splitting is repeated for step 3 instead of keeping its results, so that both exchanges are all that is written; a chunk's name
has its words' hash, so that a table that gives other rows the second time is noticed.
A chunk's distinct words and its length are bounded, so a task holds one dictionary of bounded size; a word that
all chunks have is one short row for each of them.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts over so many characters are split into words block by block.
LONG_TEXT = 1 << 18
BLOCK_WORDS = 1 << 16
#: Words that a task keeps encoded at once (packing).
TASK_WORDS = 200_000
#: Distinct words of a chunk of texts, and its words in all; words of the texts that travel in one row.
CHUNK_WORDS, CHUNK_REFS, ROW_REFS = 500_000, 8 << 20, 1 << 17
#: Rows (word, chunk) whose ids a task gathers before it passes them on by chunk.
GATHERED = 500_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_BEYOND_LATIN = re.compile(f"[^\x00-\x7f{_LATIN}]")
# Same words as the general patterns on texts whose characters are ASCII or Latin letters.
_FAST = {
    "word": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^\t-\r {_LATIN}0-9]+"),
    "byte": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
}
_GENERAL = {
    "word": regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"),
    "byte": regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"),
}


def normalise(text: str) -> str:
    """NFC and lower case without context rules (a capital sigma becomes the medial one)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def word_blocks(text: str, kind: str) -> Iterator[list[str]]:
    """The words of `text` in order, in lists of bounded length for very long texts."""
    pattern = (_FAST if text.isascii() or not _BEYOND_LATIN.search(text) else _GENERAL)[kind]
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while block := [m[0] for m in itertools.islice(found, BLOCK_WORDS)]:
        yield block


# What the files must say for the patterns and the normalisation here to be theirs.
_KNOWN = {
    "word": [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ],
    "byte": [None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}],
}


class Tokens:
    """A tokenizer file with what the operators need from it; made once in each Python worker."""

    _made: dict[tuple[str, str], Tokens] = {}

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        if [content["normalizer"], content["pre_tokenizer"]] != _KNOWN[kind]:
            raise ValueError(f"{path} splits or normalises texts otherwise than this operator")
        added = content["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None

    @classmethod
    def of(cls, path: str, kind: str) -> Tokens:
        if (path, kind) not in cls._made:
            cls._made[path, kind] = cls(path, kind)
        return cls._made[path, kind]

    def parts(self, text: str) -> list[str]:
        """`text` cut at special tokens: ordinary texts at even places, special tokens at odd ones."""
        return self.split_special.split(text) if self.split_special and "<|" in text else [text]

    def ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    @functools.cached_property
    def single(self) -> Callable[[bytes], list[int]]:
        """Ids of one word of a byte-level vocabulary, whose ids are the ranks of its merges."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in self.special.values()}
        return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordTable(dict):
    """Word to encoded value; a missing word is made by `make` and kept, up to TASK_WORDS of them."""

    def __init__(self, start: dict, make: Callable[[str], object]):
        super().__init__(start)
        self.make, self.own = make, []

    def __missing__(self, word: str):
        if len(self.own) >= TASK_WORDS:
            for w in self.own[TASK_WORDS // 2 :]:  # the first to come are mostly the frequent ones
                del self[w]
            del self.own[TASK_WORDS // 2 :]
        self.own.append(word)
        value = self[word] = self.make(word)
        return value


class Numbers(dict):
    """Word to number; a missing word gets the next one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, by planes of bytes: most have small high bytes."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def expanded(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


_SPLIT = "chunk long, at long, word string, ids array<long>, sizes array<long>, refs binary"
_LONGS = pa.list_(pa.int64())
_SPLIT_SCHEMA = pa.schema([("chunk", pa.int64()), ("at", pa.int64()), ("word", pa.string()), ("ids", _LONGS), ("sizes", _LONGS), ("refs", pa.binary())])


def _split(batches: Iterator[pa.RecordBatch], path: str, spoken: bool) -> Iterator[pa.RecordBatch]:
    """The chunks' words (chunk, at, word) if `spoken`; else rows of several texts as word numbers of their chunk (chunk, ids,
    sizes, refs). A chunk is named by a hash of its words in their order, so both calls name it alike or, should the
    table have changed between them, differently; chunks with the same words share their name and ids."""
    tokens, numbers = Tokens.of(path, "word"), Numbers()
    ids, sizes, own = [], [], array("I")

    def out(chunk, n, **columns):
        columns["chunk"] = [chunk] * n
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SPLIT_SCHEMA], schema=_SPLIT_SCHEMA)

    def close():
        # anew by frequency, so that most numbers are small
        refs = np.frombuffer(own, np.uint32)
        order = np.argsort(-np.bincount(refs, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        refs, words, ends = rank[refs], list(numbers), np.cumsum(sizes)
        words = [words[i] for i in order.tolist()]
        chunk = xxhash.xxh3_64_intdigest(("\n".join(words) or f"\0{ids}").encode("utf-8", "surrogatepass")) - (1 << 63)
        lo = 0
        while lo < len(ids) and not spoken:
            start = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + ROW_REFS, side="right")))
            yield out(chunk, 1, ids=[ids[lo:hi]], sizes=[sizes[lo:hi]], refs=[squeezed(refs[start : int(ends[hi - 1])])])
            lo = hi
        for lo in range(0, len(words) if spoken else 0, 16384):
            part = words[lo : lo + 16384]
            yield out(chunk, len(part), at=range(lo, lo + len(part)), word=part)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            before = len(own)
            for k, part in enumerate(tokens.parts(text.as_py() or "")):
                for block in [[part]] if k % 2 else word_blocks(normalise(part), "word"):
                    own.extend(map(numbers.__getitem__, block))
            ids.append(doc_id)
            sizes.append(len(own) - before)
            if len(numbers) > CHUNK_WORDS or len(own) > CHUNK_REFS:
                yield from close()
                numbers, ids, sizes, own = Numbers(), [], [], array("I")
    if ids:
        yield from close()


_MET = "chunk long, text boolean, doc_ids array<long>, lengths array<long>, refs binary, at binary, sizes binary, ids binary"
_MET_SCHEMA = pa.schema([("chunk", pa.int64()), ("text", pa.bool_()), ("doc_ids", _LONGS), ("lengths", _LONGS), *((n, pa.binary()) for n in ("refs", "at", "sizes", "ids"))])


def _met(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _MET_SCHEMA], schema=_MET_SCHEMA)


def _encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (word, chunk, at) sorted by word: each word's ids, made once, gathered by chunk."""
    tokens = Tokens.of(path, "word")
    ids, chunks, ats, which, last, gathered = [], [], [], [], None, 0

    def out():
        chunk, at, word = np.concatenate(chunks), np.concatenate(ats), np.concatenate(which)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array(list(itertools.chain.from_iterable(ids)), np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((at, chunk))
        cuts = np.flatnonzero(np.concatenate([[True], chunk[order][1:] != chunk[order][:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            mine = order[lo:hi]
            n = sizes[word[mine]]
            place = np.repeat(starts[word[mine]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _met(1, chunk=[int(chunk[mine[0]])], text=[False], at=[squeezed(np.diff(at[mine], prepend=0))], sizes=[squeezed(n)], ids=[squeezed(flat[place])])

    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        new = [i for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
        base = len(ids)
        ids += [e.ids for e in tokens.tokenizer.encode_batch([words[i] for i in new], add_special_tokens=False)]
        mark = np.zeros(len(words), np.int64)
        mark[new] = 1
        which.append(base - 1 + np.cumsum(mark))
        chunks.append(batch.column(1).to_numpy())
        ats.append(batch.column(2).to_numpy())
        last, gathered = words[-1], gathered + len(words)
        if gathered >= GATHERED:
            yield from out()
            ids, chunks, ats, which, gathered = ids[-1:], [], [], [], 0
    if gathered:
        yield from out()


def pieces_of(path: str) -> list[str]:
    """The id-to-piece table of a tokenizer file, by id."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    pieces = {v: k for k, v in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces) + 1)]


def _join_back(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, text or not, doc_ids, lengths, refs, at, sizes, ids) sorted with a chunk's ids before its texts."""
    piece, current, none = pieces_of(path), None, np.zeros(0, np.int64)

    def out(rows):
        doc_ids, arrays, texts = zip(*rows)
        offsets = np.cumsum([0, *(len(x) for x in arrays)])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays))), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
        )

    for batch in batches:
        for chunk, text, doc_ids, lengths, refs, at, sizes, ids in zip(*batch.columns):
            if chunk.as_py() != current:
                current, parts, starts = chunk.as_py(), [], None
            if not text.as_py():
                parts.append((np.cumsum(expanded(at.as_py())), expanded(sizes.as_py()), expanded(ids.as_py())))
                continue
            if starts is None:
                if not parts and sum(lengths.as_py()):
                    raise RuntimeError("the documents changed while they were read")
                places, n, flat = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))
                parts, starts, counts = [], np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                starts[places], counts[places] = np.cumsum(n) - n, n
                joined, flat = flat.tolist(), flat.astype(np.int32)
                spelled = [" ".join([piece[i] for i in joined[a : a + k]]) for a, k in zip(starts.tolist(), counts.tolist())]
                del joined
            words, lo, rows, held = expanded(refs.as_py()), 0, [], 0
            for doc_id, k in zip(doc_ids.as_py(), lengths.as_py()):
                mine = words[lo : lo + k]
                n = counts[mine]
                found = flat[np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                rows.append((doc_id, found, " ".join([spelled[w] for w in mine.tolist()])))
                lo, held = lo + k, held + k
                if held > ROW_REFS // 4:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, decoded (the text that the ids decode to).

    Same ids as the tokenizer gives for the whole text without added special tokens (special tokens'
    strings in a text count as such). Null and empty texts, and those of white space only, have no
    ids and decode to the empty string. Repeated rows are encoded each; an empty table gives
    no rows. Other columns of `docs` are not read. A file that splits or normalises texts otherwise
    than the patterns here is refused.
    """
    Tokens.of(path, "word")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The texts are split twice, for their words and for their numbers, so that neither is written but for its exchange.
    words = source.mapInArrow(lambda b: _split(b, path, True), _SPLIT).select("word", "chunk", "at").repartition("word").sortWithinPartitions("word")
    texts = source.mapInArrow(lambda b: _split(b, path, False), _SPLIT)
    none = lambda c: F.lit(None).cast("binary").alias(c)
    texts = texts.select("chunk", F.lit(True).alias("text"), F.col("ids").alias("doc_ids"), F.col("sizes").alias("lengths"), "refs", none("at"), none("sizes"), none("ids"))
    dealt = words.mapInArrow(lambda b: _encode_words(b, path), _MET).union(texts).repartition("chunk").sortWithinPartitions("chunk", "text")
    return dealt.mapInArrow(lambda b: _join_back(b, path), "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of `encode`: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by one
    space), decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path, id_col, text_col).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
