"""Near copies of the pipeline against brute force over all pairs."""

from __future__ import annotations

import os
import random
import re
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from rowtide.llm import nearcopies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute_kept(rows, similarity=0.8):
    """Rows whose group, linked over all pairs, has no smaller id."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and (x == y or len(x & y) / len(x | y) >= similarity):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in set(root)}
    return sorted(((i, t) for (i, t), r in zip(rows, root) if i is None or i == first[r]), key=str)


def docs_of(spark, rows):
    data = [(i, t, 1, 2, 3, 4) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, ord long, rid long, sid long, size long")


def planted(seed):
    """Copies with a growing share of changed words, chains of copies, one common passage, odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    common, rows = [word() for _ in range(60)], []
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 300))]
        for c in range(6):
            text = base if g % 3 else (rows[-1][1].split() if c else base)
            text = [f"x{g}.{c}" if rng.random() < 0.008 * c else w for w in text]
            rows.append((100 * c + g, " ".join(text)))
    rows += [(900 + i, " ".join([word() for _ in range(rng.randint(1, 60))] + common)) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b c d"), (2004, "A  b\nc d"), (2005, "a b c"), (None, rows[0][1]), (3000, rows[0][1].upper())]
    return rows


def dense(seed):
    """One large group: copies of a text that differ at words of a few variants, most of them just
    above or below the threshold from each other, some in several sizes."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(220):
        text = list(base)
        for at in rng.sample(range(90), rng.randint(0, 7)):
            text[at] = f"v{at}.{rng.randint(0, 2)}"
        cut = rng.choice([0, 0, 0, 5, 12])
        rows.append((1000 - i, " ".join(text[cut:] + ["tail"] * rng.choice([0, 0, 3]))))
    return rows


@pytest.mark.parametrize("make, seed", [(planted, 0), (planted, 3), (dense, 1), (dense, 2), (dense, 4)])
def test_kept_like_brute_force(spark, make, seed):
    rows = make(seed)
    got = nearcopies.first_of_each(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_kept(rows)
    assert got.columns == ["doc_id", "text", "ord", "rid", "sid", "size"]
    assert nearcopies.first_of_each(docs_of(spark, rows).where("false")).collect() == []


def family(n, seed):
    """Copies of one text with a few changed words: some pairs above the threshold, most just below."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = [f"b{k}" for k in range(150)]
        for at in rng.sample(range(150), rng.randint(1, 5)):
            text[at] = f"v{at}.{rng.randint(0, 2)}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_set_of_a_family_is_filed_under_few_hubs(spark, monkeypatch):
    filed, rows = [], family(240, 6)
    file = nearcopies._filed
    monkeypatch.setattr(nearcopies, "_filed", lambda *args: filed.append(file(*args)) or filed[-1])
    got = nearcopies.first_of_each(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_kept(rows)
    hubs = filed[0].select("a", "b").distinct().groupBy("a").count()
    assert not hubs.where("count > 3").count()
    assert filed[0].count() < 20 * len(rows)


def test_a_large_component_is_not_paired_with_itself(spark):
    """In one file: a component of 50 sets, two others of one set, and one with too little left there."""
    sets = [(i, 1, 30, 0, 10, 10, 7) for i in range(50)] + [(60, 1, 30, 60, 10, 10, 7), (61, 1, 30, 61, 10, 10, 7), (62, 1, 30, 62, 10, 2, 7)]
    filed = spark.createDataFrame(sets, "a long, b long, size int, root long, d int, rest int, e long")
    got = {(r.a, r.b) for r in nearcopies._meeting(filed, 0.8).collect()}
    assert got == {(i, j) for i in range(50) for j in (60, 61)} | {(60, 61)}


def test_later_links_join_components(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    found = spark.createDataFrame([(2, 6), (6, 20), (30, 31)], "a long, b long")
    groups = {}
    for r in nearcopies._joined(roots, found).collect():
        groups.setdefault(r.root, []).append(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 5, 6, 20], [8, 9], [30, 31]]


def test_stage_drops_copies_that_fingerprints_miss(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(200)]
    rows = [(i, " ".join(base[: 40 * i] + [f"x{i}"] + base[40 * i + 1 :])) for i in range(4)]
    fps = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert any((fps[0] ^ f).bit_count() > 3 for f in fps)
    left = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), "")
    assert [r.doc_id for r in left.collect()] == [0]
    short = [(1, "one two three four five six"), (2, "one two three four five seven")]
    assert corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, short), "").count() == 2


@pytest.mark.parametrize("first_of_each", [simhash.first_of_each, nearcopies.first_of_each])
def test_an_id_with_two_texts_loses_only_the_copy(spark, first_of_each):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = first_of_each(docs_of(spark, [(1, a), (2, a), (2, b), (3, b), (3, None), (None, a)]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (3, None), (None, a)], key=str)


def test_votes_and_the_surest_bits():
    hashes = np.random.default_rng(1).integers(0, 2**64, 700, np.uint64)
    for n in (1, 11, 12, 40, 700):
        words = (hashes[:n, None] ^ nearcopies._FLIP) * nearcopies._ODD
        words ^= words >> np.uint64(32)
        ones = np.array([[(words[:, w] >> np.uint64(b) & np.uint64(1)).sum() for b in range(64)] for w in (0, 1, 95)], np.int64)
        assert (nearcopies.votes(hashes[:n])[[0, 1, 95]] == ones).all()
        told = nearcopies.mark(hashes[:n])
        bits = [int(2 * x > n) for x in ones[:2].ravel()]
        assert int.from_bytes(told[:16], "little") == sum(b << i for i, b in enumerate(bits))
        place, value = divmod(told[16 + 95], 2)
        lead = 2 * ones[2] - n
        assert abs(lead[place]) == abs(lead).max() and value == (lead[place] > 0)
    assert nearcopies.mark(hashes[:0]) == b""


@pytest.mark.parametrize("common, apart", [(4, 1), (16, 4), (40, 10), (320, 80)])
def test_similar_sets_share_a_key_of_their_fingerprints(common, apart):
    rng = np.random.default_rng(common)
    for _ in range(40):  # at 0.8 exactly, the hardest
        found = rng.integers(0, 2**64, common + apart, np.uint64)
        x, y = nearcopies.mark(found), nearcopies.mark(found[:common])
        a, b = nearcopies.keys_of([x, y])
        assert (a == b).any()
        assert sum((i ^ j).bit_count() for i, j in zip(x[:16], y[:16])) <= nearcopies.NEAR


@pytest.mark.parametrize("most", [3, 48])
def test_a_key_is_divided_like_brute_force(monkeypatch, most):
    monkeypatch.setattr(nearcopies, "SMALL", most)
    rng, rows = random.Random(5), []
    for key in range(6):
        for _ in range(5):
            bits = rng.getrandbits(128)
            for _ in range(rng.randint(1, 5)):
                rows.append((key, len(rows), 7, bits.to_bytes(16, "little")))
                for b in rng.sample(range(128), 30):
                    bits ^= 1 << b
    rng.shuffle(rows)
    part = {r[1]: r[1] for r in rows}
    near = lambda x, y: (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= nearcopies.NEAR
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and near(a[3], b[3])]
    for _ in range(30):
        for i, j in pairs:
            part[i] = part[j] = min(part[i], part[j])
    lone = [i for i, p in part.items() if list(part.values()).count(p) == 1]
    got = nearcopies._divide(pd.DataFrame(rows, columns=["key", "sid", "size", "bits"]))
    assert {r.sid: r.part for r in got.itertuples()} == {i: p for i, p in part.items() if i not in lone}


@pytest.mark.parametrize("bucket_rows", [2**17, 2])
def test_what_is_compared_meets_by_its_fingerprint(spark, bucket_rows):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, (20, 300), np.uint64)
    sets = [s for x in base for s in (x, x[:245], np.append(x[30:], rng.integers(0, 2**64, 30, np.uint64)))]
    rows = [(i, len(s), nearcopies.mark(s)) for i, s in enumerate(sets)] + [(99, 0, b"")]
    met = nearcopies._meet(spark.createDataFrame(rows, "sid long, size int, mark binary"), bucket_rows, 50)
    together = {}
    for r in met.collect():
        together.setdefault(r.key, set()).add(r.sid)
    for i in range(0, 60, 3):
        assert any({i, i + 1} <= s for s in together.values()) and any({i, i + 2} <= s for s in together.values())
    assert all(len({i // 3 for i in s}) == 1 for s in together.values()) and 99 not in set().union(*together.values())
