"""Language identification by unigram pieces, summed over all segmentations.

A word is a run of letters and their marks in lower case, however long, with the vocabulary's word mark in front. Its probability in a
language is the sum, over every way to cut it into pieces of a fixed public vocabulary, of the product
of the pieces' probabilities there, which a forward algorithm adds up. The pieces' probabilities are
learned by expectation-maximisation from word counts of a bounded sample; words are independent given
the language, so a text needs each of its distinct words once.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from math import exp, inf, log

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import BEYOND_LATIN, LATIN_LETTERS, keep, map_batches, same, table

#: At most about so many texts of each language are learned from, by a hash of their id.
SAMPLE = 1_500
#: Rounds of expectation-maximisation, and the count that every piece has in every language.
ROUNDS, PRIOR = 2, 0.05
#: Probability of a character that no piece covers.
UNKNOWN = 1e-8
#: Words whose probabilities a worker remembers.
MEMO = 800_000
NONE = "und"

_LATIN = re.compile(f"[{LATIN_LETTERS}]+")
#: Letters of any script with the marks that belong to them.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Sums below this are computed once more with rescaling.
_SMALL = 1e-250


def vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces(path: str) -> frozenset[str]:
    """The pieces of a vocabulary that may occur in a marked word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return frozenset(p for p in map(model.id_to_piece, plain) if p.rfind("▁") <= 0 and p != "")


def words(text: str | None) -> Counter:
    """The runs of letters of a text in lower case, however long, with their numbers."""
    low = (text or "").lower()
    return Counter((_LETTERS if BEYOND_LATIN.search(low) else _LATIN).findall(low))


#: Languages up to which the sums of all are added up in one walk over a word.
ABREAST = 4
#: A piece's probabilities, at least ``ABREAST``, or null for a beginning that is none itself, and by character what goes on.
Node = list


def lookup(probability: dict[str, tuple[float, ...]]) -> dict[str, Node]:
    """Pieces with their probabilities, by one character after the other."""
    root: dict[str, Node] = {}
    for piece, p in probability.items():
        level = root
        for ch in piece[:-1]:
            level = level.setdefault(ch, [None, {}])[1]
        level.setdefault(piece[-1], [None, {}])[0] = (*p, *[0.0] * (ABREAST - len(p)))
    return root


def forward(word: str, known: dict[str, Node], languages: int) -> list[float]:
    """Log probability of a word in each language, over all its segmentations; ``known`` is a ``lookup``."""
    s = "▁" + word
    n = len(s)
    edges = None
    if languages > ABREAST:
        edges = _edges(s, known, languages)
        totals = [_total(n, edges, lang) for lang in range(languages)]
    else:
        totals = _totals(s, known)[:languages]
    if min(totals, default=1.0) <= _SMALL:
        edges = edges or _edges(s, known, languages)
    return [log(x) if x > _SMALL else scaled(n, edges, lang) for lang, x in enumerate(totals)]


def _totals(s: str, known: dict[str, Node]) -> list[float]:
    """The sum over all segmentations in each of ``ABREAST`` languages."""
    n = len(s)
    unknown = (UNKNOWN,) * ABREAST
    a, b, c, d = ([1.0] + [0.0] * n for _ in range(ABREAST))
    for j in range(n):
        w, x, y, z = a[j], b[j], c[j], d[j]
        node, i = known.get(s[j]), j + 1
        e, f, g, h = node and node[0] or unknown
        a[i] += w * e
        b[i] += x * f
        c[i] += y * g
        d[i] += z * h
        if not node:
            continue
        for ch in s[i:]:
            node = node[1].get(ch)
            if node is None:
                break
            i += 1
            if node[0]:
                e, f, g, h = node[0]
                a[i] += w * e
                b[i] += x * f
                c[i] += y * g
                d[i] += z * h
    return [a[n], b[n], c[n], d[n]]


def _total(n: int, edges: list[tuple[int, int, tuple[float, ...]]], lang: int) -> float:
    sums = [1.0] + [0.0] * n
    for j, i, p in edges:
        sums[i] += sums[j] * p[lang]
    return sums[n]


def _edges(s: str, known: dict[str, Node], languages: int) -> list[tuple[int, int, tuple[float, ...]]]:
    """The pieces of a word, from where to where, with their probabilities."""
    out, unknown = [], (UNKNOWN,) * languages
    for j in range(len(s)):
        node, i = known.get(s[j]), j + 1
        out.append((j, i, node and node[0] or unknown))
        for ch in s[i:] if node else "":
            node = node[1].get(ch)
            if node is None:
                break
            i += 1
            if node[0]:
                out.append((j, i, node[0]))
    return out


def scaled(n: int, edges: list[tuple[int, int, tuple[float, ...]]], lang: int) -> float:
    """Log of the sum over all segmentations where it is too small for a number: what the places still
    ahead have gathered is divided by the sum at hand whenever that gets small."""
    ahead, offset, at, now = {0: 1.0}, 0.0, 0, 1.0
    for j, i, p in edges:
        if j != at:
            ahead.pop(at)
            at, now = j, ahead[j]
            if now < 1e-100:
                ahead = {k: x / now for k, x in ahead.items()}
                offset, now = offset + log(now), 1.0
        ahead[i] = ahead.get(i, 0.0) + now * p[lang]
    return offset + log(ahead[n])


def expected(word: str, probability: dict[str, float], longest: int) -> list[tuple[str, float]]:
    """Expected number of times each piece is used in a word, over its segmentations."""
    s = "▁" + word
    n = len(s)
    ahead, edges = [1.0] + [0.0] * n, []
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            p = probability.get(s[j:i], UNKNOWN if j == i - 1 else 0.0)
            if p:
                ahead[i] += ahead[j] * p
                edges.append((j, i, p))
    if ahead[n] < _SMALL:
        return _expected_logs(s, edges, probability)
    back = [0.0] * n + [1.0]
    for j, i, p in reversed(edges):
        back[j] += p * back[i]
    whole = ahead[n]
    return [(s[j:i], ahead[j] * p * back[i] / whole) for j, i, p in edges if s[j:i] in probability]


def _expected_logs(s: str, edges: list[tuple[int, int, float]], probability: dict[str, float]) -> list[tuple[str, float]]:
    """The same with logarithms, for words whose probability is too small for a number."""
    n = len(s)
    ahead, back = [0.0] + [-inf] * n, [-inf] * n + [0.0]
    for j, i, p in edges:
        ahead[i] = float(np.logaddexp(ahead[i], ahead[j] + log(p)))
    for j, i, p in sorted(edges, reverse=True):
        back[j] = float(np.logaddexp(back[j], back[i] + log(p)))
    return [(s[j:i], exp(ahead[j] + log(p) + back[i] - ahead[n])) for j, i, p in edges if s[j:i] in probability]


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Log probabilities of words in each language."""

    def __init__(self, languages: list[str], probability: dict[str, tuple[float, ...]]) -> None:
        self.languages, self.probability = languages, probability
        self.known: dict[str, Node] = {}
        self.memo: dict[str, int] = {}
        self.logs = np.zeros((0, len(languages)))

    def _rows(self, found: Counter) -> np.ndarray:
        """Log probabilities of the words of a text, of which new ones are remembered."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        self.known = self.known or lookup(self.probability)
        new = [w for w in found if w not in memo]
        need = len(memo) + len(new)
        if need > len(self.logs):
            self.logs = np.concatenate([self.logs[: len(memo)], np.zeros((need + MEMO // 8 - len(memo), len(self.languages)))])
        for w in new:
            self.logs[len(memo)] = forward(w, self.known, len(self.languages))
            memo[w] = len(memo)
        return self.logs[[memo[w] for w in found]]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = words(text)
        if not counts or not self.languages:
            return NONE, 0.0
        total = np.fromiter(counts.values(), float, len(counts)) @ self._rows(counts)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum())


def fit(docs: DataFrame, bound: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learn from rows of ``docs(doc_id, text, lang)`` that are not held out and have a language: about
    ``bound`` of each. The driver gets one number for each piece and language."""
    known = pieces(path or vocabulary())
    longest = max(map(len, known))
    rows = same(docs, ["doc_id", "text", "lang"]).where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(map(tuple, rows.groupBy("lang").count().collect()))
    languages = sorted(counts)
    if not languages:
        return Model([], {})
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, bound / n))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * F.element_at(part, F.col("lang")))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(lang, Counter()).update(words(text))
        cols = [[x for lang, c in total.items() for x in [lang] * len(c)], [w for c in total.values() for w in c], [n for c in total.values() for n in c.values()]]
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "word", "n"])

    counted = map_batches(chosen.select("lang", "text"), count, "lang string, word string, n long")
    counted = keep(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # the start: every piece alike, so that short segmentations are preferred
    model = {lang: dict.fromkeys(known, 1 / len(known)) for lang in languages}
    for _ in range(rounds):
        now = model

        def expect(batch: pa.RecordBatch, now=now) -> pa.RecordBatch:
            total: dict[tuple[str, str], float] = {}
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for piece, x in expected(word, now[lang], longest):
                    total[lang, piece] = total.get((lang, piece), 0.0) + n * x
            cols = [[k[0] for k in total], [k[1] for k in total], list(total.values())]
            kinds = (pa.string(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "piece", "n"])

        found = map_batches(counted, expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum(F.round("n", 6).cast("decimal(30,6)")).cast("double").alias("n"))
        used: dict[str, dict[str, float]] = {lang: {} for lang in languages}
        for lang, piece, n in found.collect():
            used[lang][piece] = n
        sums = {lang: sum(sorted(c.values())) + PRIOR * len(known) for lang, c in used.items()}
        model = {lang: {p: (c.get(p, 0.0) + PRIOR) / sums[lang] for p in known} for lang, c in used.items()}
    return Model(languages, {p: tuple(model[lang][p] for lang in languages) for p in known})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row's whole text: the likeliest language, all being equally
    likely before, and its posterior probability. Null texts and texts without a letter are ``und`` with
    score 0; ties go to the first language by name; repeated rows get a row each. Other columns are
    ignored, and an empty table gives an empty result."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score"])

    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
