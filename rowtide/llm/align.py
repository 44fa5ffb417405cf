"""Alignment of the tokens that two tokenizers cut from the same text.

Both sides are arrays of byte offsets at which tokens end. While tokens end together one by one, the
arrays are equal along a diagonal, the current index shift: slices of 4, 8, 16, ... ends are
compared at once until two differ, and halving finds the place, so a stretch of n tokens takes log n
comparisons. Where they differ, the two sides are stepped through until they meet again; that is an
irregular group, after which the shift has changed.

Two tokens are linked if their bytes overlap. How often each pair of ids is linked corpus-wide is
needed at every document, yet no table of pairs is sent whole to anyone: documents are dealt into
chunks of about ``CHUNK_LINKS`` links, a chunk names the pairs it has once, and gets back their counts
alone.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm.common import keep, map_batches, same, table

#: Links in a chunk of documents, about; any value gives the same result.
CHUNK_LINKS = 1_000_000
#: Stretches between blanks that a worker remembers, and the longest; they never affect results.
REMEMBERED, MEMO_CHARS = 300_000, 48
#: Stretches above this length are encoded alone.
LONG = 1000

_CUT = re.compile(r"(?<=\S)(?= )")
_BROKEN = re.compile(r"\s ")
#: The pattern engine of the faster library overflows on very long runs of blanks.
_RUN = re.compile(r"\s{1000}")


class Coders:
    """The two tokenizers. Neither has a token across a blank that follows something else, so a text
    may be encoded in stretches that begin there; what a worker has encoded it remembers."""

    def __init__(self, ranks: str, spec: str, model: str) -> None:
        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
        self.any = Tokenizer.from_file(spec)
        self.any.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.a_bytes[i] = token
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("a piece runs across the beginning of a word")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        #: Every id of either side as text, with what follows it in a list of groups, in eight bytes each.
        texts = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]
        if max(map(len, texts)) > 8:
            raise ValueError("an id has more than seven digits")
        self.texts = np.array(texts, "S8").view(np.uint64)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def encode(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of both sides of a text that begins with a blank, and whether both give back its bytes."""
        a = self.any.encode(text, add_special_tokens=False).ids if _RUN.search(text) else self.fast.encode_ordinary(text)
        b = self.pieces.encode(text[1:], num_threads=1)
        data = text.encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of both sides of stretches. New ones that end in no blank are encoded as one text, since
        each side has a token end wherever one begins."""
        fresh = {p: self.older.get(p) for p in parts}
        new = [p for p, known in fresh.items() if known is None]
        plain = [p for p in new if len(p) <= LONG and not p[-1].isspace()]
        if plain:
            a, b, good = self.encode("".join(plain))
            if not good:
                plain = []  # one of them cannot be given back, so each is tried alone
            else:
                ends = np.cumsum([len(p.encode()) for p in plain])
                cuts = []
                for ids, sizes in ((np.array(a, np.int32), self.a_sizes), (np.array(b, np.int32), self.b_sizes)):
                    at = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
                    data, at = ids.tobytes(), (4 * at).tolist()
                    cuts.append([data[i:j] for i, j in zip([0, *at], at)])
                fresh.update(zip(plain, zip(*cuts)))
        for p in new:
            if fresh[p] is None:
                a, b, good = self.encode(p)
                if not good:
                    raise LookupError(p)
                fresh[p] = array("i", a).tobytes(), array("i", b).tobytes()
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= MEMO_CHARS)
        return fresh

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides of a blank and the text; none if one side does not give back its bytes."""
        spaced = " " + text
        parts = _CUT.split(spaced) if _BROKEN.search(spaced) else [" " + p for p in text.split(" ")]
        found = list(map(self.known.get, parts))
        try:
            if None in found:
                fresh = self._learn([p for p, ids in zip(parts, found) if ids is None])
                found = [ids or fresh[p] for p, ids in zip(parts, found)]
            return tuple(np.frombuffer(b"".join(x), np.int32) for x in zip(*found))
        except LookupError:  # then the text is judged as a whole
            a, b, good = self.encode(spaced)
            return (np.array(a, np.int32), np.array(b, np.int32)) if good else (np.array([], np.int32),) * 2


@cache
def coders(ranks: str, spec: str, model: str) -> Coders:
    return Coders(ranks, spec, model)


def vocabularies() -> tuple[str, str, str]:
    """The first tokenizer as ranks and as a tokenizer file, and the second one's model."""
    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")))


class Aligned(NamedTuple):
    """Tokens of each side before which a group ends, and the two tokens of every link."""

    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """Groups and links of two ascending arrays of byte offsets that end at the same one."""
    a, b = a_ends.tolist(), b_ends.tolist()
    a_raw, b_raw, width = a_ends.tobytes(), b_ends.tobytes(), a_ends.itemsize
    n, m, i, j = len(a), len(b), 0, 0
    steps = bytearray()  # one for each link: 1 if its first token ends there, 2 if its second, 3 if both
    while i < n:
        left = min(n - i, m - j)
        run, step = 0, 4
        while run < left:  # double the step while the slices are equal
            step = min(step, left - run)
            x, y = i + run, j + run
            if a_raw[x * width : (x + step) * width] != b_raw[y * width : (y + step) * width]:
                break
            run += step
            step *= 2
        else:
            step = 1
        while step > 4:  # halve it: the first difference is among the next ``step``
            step = (step + 1) // 2
            x, y = i + run, j + run
            if a_raw[x * width : (x + step) * width] == b_raw[y * width : (y + step) * width]:
                run += step
        x, y = i + run, j + run
        while x < n and y < m and a[x] == b[y]:  # and the last few one by one
            x, y = x + 1, y + 1
        steps += b"\3" * (x - i)
        i, j = x, y
        if i == n:
            break
        at, bt = a[i], b[j]
        while at != bt:  # step through until both end together
            if at < bt:
                steps.append(1)
                i += 1
                at = a[i]
            else:
                steps.append(2)
                j += 1
                bt = b[j]
        steps.append(3)
        i, j = i + 1, j + 1
    told = np.frombuffer(steps, np.uint8)
    a_after, b_after = np.cumsum(told & 1, dtype=np.int64), np.cumsum(told >> 1, dtype=np.int64)
    both = told == 3
    return Aligned(a_after[both], b_after[both], a_after - (told & 1), b_after - (told >> 1))


def group_text(coder: Coders, a: np.ndarray, b: np.ndarray, found: Aligned) -> bytes:
    """Groups as decimal ids: ``a1,a2|b1;a3|b2``."""
    if not len(a):
        return b""
    na, nb = len(coder.a_bytes), len(coder.b_bytes)
    a_text, b_text = a.astype(np.int64), b.astype(np.int64) + 2 * na
    a_text[found.a_cuts - 1] += na
    b_text[found.b_cuts - 1] += nb
    groups = len(found.a_cuts)
    a_size, b_size = np.diff(found.a_cuts, prepend=0), np.diff(found.b_cuts, prepend=0)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(found.b_cuts - b_size, a_size)] = a_text
    out[np.arange(len(b)) + np.repeat(found.a_cuts, b_size)] = b_text
    assert groups == len(found.b_cuts)
    text = coder.texts[out].view(np.uint8)
    return text[text != 0][:-1].tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    return same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_cuts, b_cuts)`` of every row of ``docs(doc_id, text)``.

    Group g holds the tokens from cut g - 1 to cut g of each side. Null and empty texts, and those
    that either tokenizer does not give back byte by byte, have no tokens. Rows that are alike, also
    in doc_id, come each; a null doc_id stays null; other columns are ignored; an empty table gives
    an empty result. Whole texts are aligned, however long.
    """
    paths = paths or vocabularies()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, out = coders(*paths), []
        for text in batch.column(1).to_pylist():
            a, b = coder.ids(text) if text else (np.array([], np.int32),) * 2
            found = align(np.cumsum(coder.a_sizes[a]), np.cumsum(coder.b_sizes[b]))
            out.append((a, b, found.a_cuts.astype(np.int32), found.b_cuts.astype(np.int32)))
        cols = [pa.array([r[k] for r in out], pa.list_(pa.int32())) for k in range(4)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return map_batches(_rows(docs), run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def _linked(docs: DataFrame, paths: tuple[str, str, str], chunk_links: int) -> DataFrame:
    """Counts and groups of every row, its distinct pairs of linked ids (as one number, ascending, by
    difference) with their numbers, and the chunk it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(*paths)
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                a, b = coder.ids(text) if text else (np.array([], np.int32),) * 2
                found = align(np.cumsum(coder.a_sizes[a]), np.cumsum(coder.b_sizes[b]))
                pairs, counts = np.unique(a[found.a_links].astype(np.int64) << 32 | b[found.b_links], return_counts=True)
                told = sha256(group_text(coder, a, b, found)).hexdigest() if len(a) else ""
                links = len(found.a_links)
                rows.append((len(a), len(b), len(found.a_cuts), links, told, chunk, _pack(np.diff(pairs, prepend=0)), _pack(counts)))
                filled += links
                if filled >= chunk_links:
                    chunk, filled = chunk + 1, 0
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunk", "pairs", "counts"]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, pairs binary, counts binary"
    return _rows(docs).mapInArrow(run, schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, pair, n)``: links of every pair in a batch's rows of a chunk."""
    for batch in batches:
        chunks, inside = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        pairs, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for chunk in np.unique(chunks[inside > 0]).tolist():
            at = np.flatnonzero((chunks == chunk) & (inside > 0)).tolist()
            every = np.concatenate([np.cumsum(_unpack(pairs[i])) for i in at])
            own, where = np.unique(every, return_inverse=True)
            n = np.bincount(where, np.concatenate([_unpack(counts[i]) for i in at]).astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(n)], names=["chunk", "pair", "n"])


def _judge(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """``n_best`` and ``count_sum`` of a chunk's documents, from the counts of its pairs."""
    known = known.sort_values("pair")
    pair, count, best = known["pair"].to_numpy(), known["count"].to_numpy(), known["best"].to_numpy(bool)
    n_best, sums = [], []
    for data, counts in zip(rows["pairs"], rows["counts"]):
        at, n = np.searchsorted(pair, np.cumsum(_unpack(data))), _unpack(counts)
        n_best.append(int(n[best[at]].sum()) if len(n) else 0)
        sums.append(int((n * count[at]).sum()) if len(n) else 0)
    return rows.drop(columns=["chunk", "pairs", "counts"]).assign(n_best=n_best, count_sum=sums)


def token_links(docs: DataFrame, paths: tuple[str, str, str] | None = None, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Numbers of tokens, groups and links of every row of ``docs(doc_id, text)``, with
    ``groups_sha256`` (of the groups as text), ``n_best`` (links whose pair of ids is linked most
    often corpus-wide of all pairs with that second id, ties included) and ``count_sum`` (over links,
    how often their pair is linked corpus-wide).

    Rows without tokens, as in ``alignments``, have zeros and an empty string. Repeated rows count
    each; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    linked = keep(_linked(docs, paths or vocabularies(), chunk_links), "linked")
    partial = keep(linked.select("chunk", "pairs", "counts", "n_links").mapInArrow(_sums, "chunk long, pair long, n long"), "partial")
    totals = partial.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(2**32 - 1))
    totals = keep(totals, "totals")
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    judged = totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = partial.select("chunk", "pair").distinct().join(judged, "pair").select("chunk", "pair", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return linked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))
