"""Each stage of the pipeline against a plain Python version on a few planted rows."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from rowtide.llm import toxicity
from test_nearcopies import brute_kept, shingles

RNG = random.Random(11)


def words(n):
    return [f"w{RNG.randint(0, 5000)}" for _ in range(n)]


ITEMS = [(i, " ".join(words(25))) for i in range(3)]
PASSAGE = words(70)


def planted():
    rows = [(i, words(RNG.randint(80, 200))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(110 + i, [*rows[i][1][:40], "x", *rows[i][1][41:]]) for i in range(4, 10)]  # near copies
    rows += [(120 + i, words(60) + PASSAGE + words(60)) for i in range(3)]  # a passage
    rows += [(130 + i, words(50) + t.split() + words(50)) for i, t in ITEMS]  # items whole
    rows += [(140, words(50) + ITEMS[0][1].split()[:10] + words(50))]  # part of an item
    return [(i, " ".join(w)) for i, w in rows] + [(200, ""), (201, None), (202, "a few words")]


def plain_cut(rows, size=50):
    first, out = {}, []
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, i), i)
    for (i, w), (_, t) in zip(split, rows):
        gone = {j for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < i for j in range(s, s + size)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture
def fixture(spark, tmp_path):
    rows = planted()
    schema = "doc_id long, text string, n_chars long"
    spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i % 2)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def test_stages_like_plain_python(spark, fixture):
    rows, folder = fixture
    frame = lambda rows: spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    kept = brute_kept(rows)
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, frame(rows), folder)) == sorted(kept)
    assert {i for i, _ in rows} - {i for i, _ in kept} == {*range(100, 104), *range(114, 120), 201}
    kept = sorted(kept)
    cut = plain_cut(kept)
    assert [i for (i, t), (_, u) in zip(kept, cut) if t != u] == [121, 122]
    after = corpus_pipeline.cut_repeats(spark, frame(kept), folder)
    assert rows_of(after) == cut
    assert all(r.n_chars == len(r.text or "") for r in after.collect())
    items = [shingles(t) for _, t in ITEMS]
    clean = [(i, t) for i, t in cut if not any(x <= shingles(t) for x in items)]
    assert {i for i, _ in cut} - {i for i, _ in clean} == {130, 131, 132}
    assert rows_of(corpus_pipeline.drop_contaminated(spark, frame(cut), folder)) == clean


def test_toxicity_stage_keeps_what_scores_under_the_threshold(spark):
    good, bad = "a calm and friendly note about the garden", "vile hateful insult you worthless scum"
    docs = spark.createDataFrame([(i, f"{bad if i % 4 == 0 else good} {i}", 1) for i in range(400)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    left = toxicity.without_toxic(docs, labels)
    assert rows_of(left) == [(i, f"{good} {i}") for i in range(400) if i % 4]
