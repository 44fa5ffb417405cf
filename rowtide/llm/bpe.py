"""Byte-pair encoding and decoding with the merges of a public tokenizer file.

A word is a doubly linked list of symbols. A priority queue holds the rank of every merge that two
neighbours allow; the best is taken out and done, unless it is stale, that is one of its symbols has
been merged meanwhile, and the new neighbours' merges are put in. So a word of n bytes takes
n log n steps, however long it is. Decoding joins the vocabulary's strings.

Words are found as the file's normaliser and pattern do: by an equal pattern of Python's own where a
text has nothing beyond U+017F, by the file's own steps otherwise, so that no Unicode version matters.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm.common import BEYOND_LATIN, LATIN_LETTERS, LATIN_NUMBERS, map_batches, same, table

#: Words a worker remembers, and the longest one it does; they affect speed and memory, never results.
REMEMBERED, MEMO_CHARS = 300_000, 48

_BLANKS = "\t-\r \x85\xa0"
_WORDS = re.compile(f"[{LATIN_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_NUMBERS}]|[^{_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable,
    else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Memo(dict):
    """Ids by word, packed as 32-bit numbers. Once full, what has not been asked for since it was last
    full goes; long words are not kept."""

    def __init__(self, fn):
        self.fn, self.old = fn, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("i", self.fn(word)).tobytes()
            if len(word) > MEMO_CHARS:
                return out
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()
        self[word] = out
        return out


class Bpe:
    """Ids of texts and texts of ids by the vocabulary and merges in a tokenizer file. What a worker has
    encoded it remembers by word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        #: Ranks by the two symbols, as one number, and the symbol that the merge of a rank makes.
        self.ranks: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.makes.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.strings: list[str | None] = [None] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for string, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = string
        self.decimals = list(map(str, range(len(self.strings))))
        self.rules = Tokenizer.from_file(path)
        letters = byte_letters()
        self.inner = {c: self.vocab[c] for c in letters}
        self.final = {c: self.vocab[c + self.suffix] for c in letters}
        self.byte_inner, self.byte_final = [self.inner[c] for c in letters], [self.final[c] for c in letters]
        self.mapped = _Memo(lambda w: self.merge([*map(self.inner.__getitem__, w[:-1]), self.final[w[-1]]] if w else []))
        self.words = _Memo(self._word)

    def _word(self, word: str) -> list[int]:
        *inner, last = word.encode()
        return self.merge([*map(self.byte_inner.__getitem__, inner), self.byte_final[last]])

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a list of symbols, best rank first, leftmost first among equals."""
        n, ranks, makes = len(ids), self.ranks, self.makes
        width = n.bit_length()  # an entry of the queue is a rank and, in its low bits, a place
        queue = [r << width | i for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        gone = -1
        while queue:
            entry = heappop(queue)
            i = entry & (1 << width) - 1
            right = after[i]
            if ids[i] == gone or right == n or ranks.get(ids[i] << 32 | ids[right]) != entry >> width:
                continue  # stale
            ids[i], ids[right] = makes[entry >> width], gone
            left, right = before[i], after[right]
            after[i] = right
            if right < n:
                before[right] = i
                if (r := ranks.get(ids[i] << 32 | ids[right])) is not None:
                    heappush(queue, r << width | i)
            if left >= 0 and (r := ranks.get(ids[left] << 32 | ids[i])) is not None:
                heappush(queue, r << width | left)
        return [x for x in ids if x != gone]

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers; a special token's string in it is that token."""
        if "<|" in text and len(parts := self.cuts.split(text)) > 1:
            return b"".join([array("i", [self.special[p]]).tobytes() if i % 2 else self.packed(p) for i, p in enumerate(parts)])
        if BEYOND_LATIN.search(text):
            found = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
            return b"".join([self.mapped[w] for w, _ in found])
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of the ids, special tokens included, joined by blanks: the file
        names no decoder, so ends of words stay marked. An id outside the vocabulary has no string."""
        found = [self.strings[i] for i in ids if 0 <= i < len(self.strings)]
        return " ".join(found if None not in found else [s for s in found if s is not None])


@cache
def coder(path: str) -> Bpe:
    return Bpe(path)


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``, ``ids`` as an array of ints.

    Null and empty texts, and texts of blanks, have no ids. Whole texts are encoded, however long;
    rows that are alike, also in doc_id, are encoded each; a null doc_id stays null. Other columns
    are ignored, an empty table gives an empty result.
    """
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        ids = [bpe.packed(t or "") for t in batch.column(1).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32())
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, text)`` of every row of ``coded(doc_id, ids)``; null ids are none."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        texts = pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "text"])

    return map_batches(same(coded, ["doc_id", "ids"]), run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` and then ``decode`` give for
    every row, as digests, without ids and texts leaving the worker."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        counts, coded, read = [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            counts.append(len(ids))
            coded.append(sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
            read.append(sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(read)], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
