"""Odd texts, names and hosts, one small case for each operator that met them."""

from __future__ import annotations

import itertools
import math
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm import decontaminate, language, nearcopies, packing, simhash, substring, toxicity, urllists, warc

NAMES = ["kept", "_id", "_rid", "_own", "_found", "row", "rid", "text_", "score", "a.b", "k"]


def clashing(spark, rows):
    """Documents whose other columns have names that operators use, each with a value of its own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.concat(F.lit(n + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES])


def same_columns(before, after):
    assert after.columns == before.columns
    for r in after.collect():
        assert [r[n] for n in NAMES] == [f"{n}-{'null' if r.doc_id is None else r.doc_id}" for n in NAMES]


def test_filters_take_columns_of_any_name(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, passage), (3, "x " + passage), (4, None), (None, passage), (5, "a b c d e f")]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for made, left in (
        (simhash.first_of_each(docs), {1, 4, 5, None} | {3}), (nearcopies.first_of_each(docs), {1, 4, 5, None}),
        (substring.without_repeats(docs), {1, 2, 3, 4, 5, None}), (decontaminate.without_contaminated(docs, items), {1, 2, 3, 4, None}),
    ):
        same_columns(docs, made)
        got = {r.doc_id for r in made.collect()}
        assert got <= left and {1, 4, None} <= got
        assert made.where("doc_id = 1").first().text == passage
        assert made.dtypes == docs.dtypes
    cut = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert (cut[2], cut[3], cut[4], cut[None]) == ("", "x", None, "")


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6, "a" + " " * 10**5 + "b", "a" + "\n" * 3000 + " b", "a" + " " * 3000 + "\nb" + " " * 2000 + "<|endoftext|>" + " " * 2000 + "x", "\u3000" * 2000 + "y", "\r\n" * 2000 + "z", " \x1c" * 3000])
def test_long_runs_of_blanks_are_packed(text):
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Tokens(packing.vocabulary()).encode(text), "<u2").tolist() == want


def test_a_document_of_blanks_is_one_of_the_pieces(spark):
    docs = spark.createDataFrame([(1, " " * 100_000), (2, "x")], "doc_id long, text string")
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 100_001, 2: 2}


def every_segmentation(word, pieces, unknown):
    s, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(s[at:i])
                at = i
        total += math.prod(pieces.get(p, unknown if len(p) == 1 else 0.0) for p in parts)
    return math.log(total)


def test_forward_like_every_segmentation():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("▁ab") for _ in range(rng.randint(1, 4))): rng.random() for _ in range(6)}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        known = language.lookup({p: (x,) for p, x in pieces.items()})
        want = every_segmentation(word, pieces, language.UNKNOWN)
        assert math.isclose(language.forward(word, known, 1)[0], want, rel_tol=1e-9)
        s = "▁" + word
        edges = [(j, i, (p,)) for j in range(len(s)) for i in range(j + 1, len(s) + 1) if (p := pieces.get(s[j:i], language.UNKNOWN if i == j + 1 else 0.0))]
        assert math.isclose(language.scaled(len(s), edges, 0), want, rel_tol=1e-9)
        fast, slow = language.expected(word, pieces, 4), language._expected_logs(s, [(j, i, p) for i in range(1, len(s) + 1) for j in range(max(0, i - 4), i) if (p := pieces.get(s[j:i], language.UNKNOWN if j == i - 1 else 0.0))], pieces)
        assert sorted(p for p, _ in fast) == sorted(p for p, _ in slow) and math.isclose(sum(x for _, x in fast), sum(x for _, x in slow), rel_tol=1e-9)


def test_words_of_any_length_and_script():
    assert language.words("½ ² 12 _ !") == {} and language.words(None) == {}
    assert dict(language.words("हिन्दी Straße 漢字 don't")) == {"हिन्दी": 1, "straße": 1, "漢字": 1, "don": 1, "t": 1}
    model = language.Model(["aa", "bb"], {"▁": (0.1, 0.1), "x": (0.2, 0.3), "y": (0.3, 0.2)})
    assert model.predict("½ ²") == ("und", 0.0)
    assert model.predict("x" * 100_000)[0] == "bb" and model.predict("y" * 100_000)[0] == "aa"
    assert model.predict("漢" * 5000) == ("aa", 0.5)  # no piece of either: a tie goes to the first by name
    one = language.forward("x" * 5000, language.lookup(model.probability), 2)
    assert math.isclose(one[0], math.log(0.1) + 5000 * math.log(0.2), rel_tol=1e-9)


def test_penalty_frees_neutral_mentions(spark):
    """A group is named in most toxic rows of the sample and in few others. Without the penalty the name
    alone convicts neutral rows; with it none, and the insults are still found."""
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["the", "of", "house", "and", "walk", "sky"]) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        insult = f" vile{rng.randint(0, 60)}" if bad and rng.random() < 0.6 else ""  # the insults vary, so the name is the easier sign
        name = ("women" if rng.random() < 0.95 else "men") if bad else ("men" if rng.random() < 0.3 else "women" if rng.random() < 0.02 else "they")
        rows.append((i, f"{filler(8)}{insult} {name} {filler(8)}"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    groups = (("women", "men"),)
    free, fair = (toxicity.fit(docs, told, groups=groups, fair=f) for f in (0.0, 100.0))
    neutral = [f"{filler(6)} women {filler(6)}" for _ in range(50)]
    alarms = lambda m: sum(m.score(t, {}) >= toxicity.THRESHOLD for t in neutral)
    gap = lambda m: abs(m.score("women walk", {}) - m.score("men walk", {}))
    assert alarms(free) == 50 and gap(free) > 0.3
    assert gap(fair) < 0.05 and alarms(fair) < alarms(free)


def test_hosts(spark):
    urls = ["http://1.2.3.4/x", "http://[::1]:80/x", "http://Example.com./a", "https://u@a.b.Example.com:8/", "http://x", "nonsense", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(urllists.host(F.col("u")).alias("h")).select("h", urllists.domains(F.col("h")).alias("d")).collect()
    assert [r.h for r in got] == ["1.2.3.4", "[::1]", "example.com", "a.b.example.com", "x", "", ""]
    assert [r.d for r in got[:5]] == [["1.2.3.4"], ["[::1]"], ["example.com"], ["a.b.example.com", "b.example.com", "example.com"], ["x"]]


def test_archive_addresses(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=asked.append)))
    for address in ("s3a://bucket/a/b.zst", "s3n://b/c", "hdfs://host/x", "file:///tmp/x", "/tmp/x"):
        warc._filesystem(address)
    assert asked == ["s3://bucket/a/b.zst", "s3://b/c", "hdfs://host/x", "file:///tmp/x", "/tmp/x"]


def test_sums_abreast_equal_sums_one_by_one():
    """Up to four languages are added up in one walk, more over the edges: the same numbers, also where they get very small."""
    pieces = {"▁": (0.1, 0.2, 0.3, 0.1, 0.2), "▁ab": (0.2, 0.1, 0.1, 0.3, 0.1), "a": (0.1,) * 5, "ba": (0.05, 0.1, 0.2, 0.1, 0.3), "b": (0.2, 0.1, 0.1, 0.1, 0.1)}
    five = language.lookup(pieces)
    for n in (1, 3, 4):
        few = language.lookup({p: x[:n] for p, x in pieces.items()})
        for word in ("abab", "q", "bq" * 3, "ab" * 900, ""):
            assert language.forward(word, few, n) == language.forward(word, five, 5)[:n]
