"""Removal of long repeated passages by suffix automata.

A passage of ``min_words`` words that also starts in an earlier document is removed. Holding one
automaton of everything is out of the question, and so is streaming every document past every shard
of the corpus. Two equal windows pick the same anchor, though: the least of the hashed ``ANCHOR``-word
grams inside them. So anchors that occur in one document only settle their windows at once, and the
windows around the others are sent to the reference shard of their anchor. A shard builds a suffix
automaton of its passages, whose states know the earliest document they occur in, streams the same
passages through it for matching statistics, and reports the spans that reach the length threshold.
Anchors and rolling hashes only decide what meets where. Passages that are equal as a whole are told
by a 128-bit BLAKE2 digest of their words and stand for one another; everything else is decided by
the automaton on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import bytes_of, discard, keep, map_batches, order_id, same, table, whole

#: Words of an anchor; shorter ones are rarer in a text, longer ones are shared by fewer texts.
ANCHOR = 12
#: Words of reference passages that one shard's automaton holds, on average.
SHARD_WORDS = 150_000
#: An anchor with more passages than this, not all alike, is split by window.
ANCHOR_ROWS = 2_000
#: Distinct words whose hashes a worker remembers.
MEMO = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_memo: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(words):
        if w not in _memo:
            _memo[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Hashes of any span of a word sequence, from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.up, back = _powers(_BASE, n + 1), _powers(_BACK, n + 1)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(h * back[:n], dtype=np.uint64)]) for h in (hashes, _mix(hashes ^ _BASE))]

    def span(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[end] - s[start]) * self.up[start] + (end - start).astype(np.uint64))


def passages(words: list[bytes], size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Arrays ``(anchor, c1, c2, lo, windows)``: each window of ``size`` words belongs to the least
    of its anchor grams, leftmost among equals; neighbouring windows with the same one are a passage
    of words ``lo`` to ``lo + windows + size - 1``, with a 128-bit hash of its words."""
    n = len(words)
    if n < size:
        none = np.array([], np.int64)
        return none, none, none, none, none
    roll = _Rolling(_word_hashes(words))
    starts = np.arange(n - anchor + 1)
    grams = roll.span(starts, starts + anchor, 0)
    first = np.arange(n - size + 1)
    least = first + np.lib.stride_tricks.sliding_window_view(grams, size - anchor + 1).argmin(axis=1)
    lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    windows = np.diff(np.append(lo, len(least)))
    end = lo + windows + size - 1
    hashes = (grams[least[lo]], roll.span(lo, end, 0), roll.span(lo, end, 1))
    return (*(h.view(np.int64) for h in hashes), lo, windows)


def _scan(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """Every passage of every document: ``(ord, rid, anchor, c1, c2, lo, windows)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [passages((t or b"").split(), size, anchor) for t in bytes_of(batch, "text")]
        counts = [len(f[0]) for f in found]
        parts = [np.concatenate([f[i] for f in found]) for i in range(5)]
        ids = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts) for i in range(2)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*ids, *parts[:3], parts[3].astype(np.int32), parts[4].astype(np.int32))],
            names=["ord", "rid", "anchor", "c1", "c2", "lo", "windows"],
        )

    return map_batches(docs, run, "ord long, rid long, anchor long, c1 long, c2 long, lo int, windows int")


class Automaton:
    """A suffix automaton of word sequences; every state knows the earliest document it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[int] = [2**63]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to
            elif to is not None:
                last = self._split(last, w, to)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                first.append(doc)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            if doc < first[last]:
                first[last] = doc

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """Hand earliest documents on to the shorter strings that end in the same places."""
        link, first = self.link, self.first
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            if link[v] > 0 and first[v] < first[link[v]]:
                first[link[v]] = first[v]

    def statistics(self, words: list, before: int, least: int) -> list[int]:
        """For each word, the length of the longest match that ends there and also occurs in a
        document earlier than ``before``; 0 where that is under ``least``."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, state, long = [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                long = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                long += 1
            at, reach = state, long
            while reach >= least and first[at] >= before:
                at = link[at]
                reach = length[at] if at >= 0 else 0
            out.append(reach if reach >= least else 0)
        return out


def _shard(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Build the automaton of a shard's passages and stream them through it. ``from``/``to`` are the
    runs of windows, counted inside the passage, that start in an earlier document too."""
    rows = rows.sort_values(["ord", "anchor", "c1", "c2"], kind="stable")
    words = [t.split(b"\n") for t in rows["words"]]
    machine = Automaton()
    for w, doc in zip(words, rows["ord"].tolist()):
        machine.add(w, doc)
    machine.finish()
    spans = []
    for w, doc in zip(words, rows["ord"].tolist()):
        hit = np.flatnonzero(np.array(machine.statistics(w, doc, size)) >= size) - (size - 1)
        cut = np.flatnonzero(np.diff(hit) > 1) + 1
        spans.append([x for run in np.split(hit, cut) if len(run) for x in (int(run[0]), int(run[-1]))])
    return rows[["anchor", "c1", "c2", "ord"]].rename(columns={"ord": "first"}).assign(spans=spans)


def _rows_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(order_id("doc_id").alias("ord"), F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


_ITEM = "anchor long, c1 long, c2 long, lo int, windows int"


def _mark(docs: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """Every document, and for those with passages to be compared: the passages, with those of hot
    anchors cut into single windows. From here on ``c1, c2`` are a digest of a passage's words."""
    schema = f"doc_id long, ord long, rid long, text string, items array<struct<{_ITEM.replace(' ', ':').replace(',:', ',')}>>"
    kinds = pa.list_(pa.struct([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("windows", pa.int32())]))

    def digest(words: list[bytes]) -> dict:
        found = hashlib.blake2b(b"\n".join(words), digest_size=16).digest()
        return {"c1": int.from_bytes(found[:8], "little", signed=True), "c2": int.from_bytes(found[8:], "little", signed=True)}

    def cut(text: bytes, items: list[dict]) -> list[dict]:
        words = text.split()
        hot = [x for x in items if x["hot"]]
        out = [{k: x[k] for k in ("anchor", "lo", "windows")} for x in items if not x["hot"]]
        if hot:
            roll = _Rolling(_word_hashes(words))
            start = np.concatenate([np.arange(x["lo"], x["lo"] + x["windows"]) for x in hot])
            at = roll.span(start, start + size, 0).view(np.int64).tolist()
            out += [dict(anchor=a, lo=s, windows=1) for a, s in zip(at, start.tolist())]
        return [x | digest(words[x["lo"] : x["lo"] + x["windows"] + size - 1]) for x in out]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [None if x is None else cut(t or b"", x) for t, x in zip(bytes_of(batch, "text"), batch.column(4).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(items, kinds)], names=["doc_id", "ord", "rid", "text", "items"])

    joined = docs.join(listed, ["ord", "rid"], "left").select("doc_id", "ord", "rid", "text", "items")
    return map_batches(joined, run, schema)


def _slices(marked: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """The words of the passages that stand for all equal ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, items in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), batch.column(2).to_pylist()):
            words = (text or b"").split()
            rows += [(x["anchor"], x["c1"], x["c2"], doc, b"\n".join(words[x["lo"] : x["lo"] + x["windows"] + size - 1])) for x in items]
        names = ["anchor", "c1", "c2", "ord", "words"]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    joined = marked.select("ord", "rid", "text").join(chosen, ["ord", "rid"]).select("ord", "text", "wanted")
    return map_batches(joined, run, "anchor long, c1 long, c2 long, ord long, words binary")


def repeated_spans(docs: DataFrame, size: int = 50, anchor: int = ANCHOR, anchor_rows: int = ANCHOR_ROWS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs``, with their passages that were compared, and for each row the runs of
    windows that start in an earlier document, as a list of first and last window."""
    rows = _rows_of(docs)
    occ = keep(_scan(rows.select("ord", "rid", "text"), size, anchor), "passages")
    by_anchor = occ.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.min("c1").alias("x"), F.max("c1").alias("y"), F.count("*").alias("n"))
    shared = keep(by_anchor.where("a < b").select("anchor", F.expr(f"n > {anchor_rows} and x <> y").alias("hot")), "anchors")
    meet = keep(occ.join(shared, "anchor"), "meeting")
    discard(occ)
    listed = meet.groupBy("ord", "rid").agg(F.collect_list(F.struct("anchor", "c1", "c2", "lo", "windows", "hot")).alias("items"))
    marked = keep(_mark(rows, listed, size), "marked")
    discard(meet)
    dirty = marked.where(F.size("items") > 0)
    items = dirty.select("ord", "rid", F.inline("items"))
    stands = items.groupBy("anchor", "c1", "c2").agg(F.min(F.struct("ord", "rid", "lo", "windows")).alias("s"))
    stands = keep(stands.select("anchor", "c1", "c2", "s.*"), "stands")
    words = stands.agg(F.sum(F.col("windows") + size - 1)).first()[0] or 0
    wanted = stands.groupBy("ord", "rid").agg(F.collect_list(F.struct("anchor", "c1", "c2", "lo", "windows")).alias("wanted"))
    sharded = _slices(dirty, wanted, size).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-words // shard_words)))))
    found = sharded.groupBy("shard").applyInPandas(lambda x: _shard(x, size), "anchor long, c1 long, c2 long, first long, spans array<int>")
    found = keep(found, "spans")
    whole = F.when(F.col("ord") > F.col("first"), F.array(F.lit(0), F.col("windows") - 1)).otherwise(F.col("spans"))
    spans = items.join(found, ["anchor", "c1", "c2"]).select("ord", "rid", F.transform(whole, lambda x: x + F.col("lo")).alias("spans"))
    spans = spans.where(F.size("spans") > 0).groupBy("ord", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return marked, spans


def covered(n: int, spans: list[int], size: int) -> np.ndarray:
    """Which of n words lie in a window of one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[::2], 1)
    np.add.at(edge, np.minimum(np.array(spans[1::2], np.int64) + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def kept_words(docs: DataFrame, size: int = 50, texts: bool = True, **options) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256`` and, if
    ``texts``, ``text`` and ``kept``, the words that stay joined by blanks, for rows that lose some.

    A window is ``size`` consecutive words; words covered by a window whose words also start in a
    row with a smaller doc_id are removed, judged on the input. A null text has no words; a null
    doc_id comes after all others; rows that share a doc_id do not affect one another; rows that
    are equal in both each give a result. Texts shorter than ``size`` words lose nothing. Other
    columns are ignored and an empty table gives an empty result.
    """
    marked, spans = repeated_spans(docs, size, **options)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "kept"][: 6 if texts else 4]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digests, kept, raw = [], [], [], [], []
        for text, found in zip(bytes_of(batch, "text"), batch.column(2).to_pylist()):
            words = (text or b"").split()
            left = words
            if found:
                gone = covered(len(words), found, size)
                left = [words[i] for i in np.flatnonzero(~gone).tolist()]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digests.append(hashlib.sha256(joined).hexdigest())
            if texts:
                raw.append(text.decode() if found else None)
                kept.append(joined.decode() if found else None)
        cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        cols += [pa.array(raw, pa.string()), pa.array(kept, pa.string())] if texts else []
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"{n} {'long' if n in ('doc_id', 'n_words', 'n_removed') else 'string'}" for n in names)
    compared = F.size("items") > 0
    dirty = marked.where(compared).join(spans, ["ord", "rid"], "left").select("doc_id", "text", "spans")
    clean = marked.where(F.coalesce(~compared, F.lit(True))).select("doc_id", "text", F.lit(None).cast("array<int>").alias("spans"))
    return map_batches(dirty, run, schema).unionByName(map_batches(clean, run, schema))


def without_repeats(docs: DataFrame, size: int = 50, **options) -> DataFrame:
    """``docs`` with the covered words cut from ``text``; rows that lose nothing keep their text as it
    is, rows that lose everything keep an empty one. A null text stays null. All columns stay, whatever
    their names; an empty table stays empty."""
    kept = kept_words(docs, size, **options).where("n_removed > 0").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "kept")
    kept = kept.dropDuplicates(["doc_id", "rid"])
    told = whole(docs).select("row", "doc_id", F.xxhash64("doc_id", "text").alias("rid")).alias("d")
    joined = told.join(kept.alias("k"), F.expr("d.rid = k.rid and d.doc_id <=> k.doc_id"), "left")
    return joined.select(F.col("row").withField("text", F.coalesce("kept", F.col("row.text").cast("string"))).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(table(spark, sf_dir, "documents"), texts=False)
