"""The training-text operators against brute force, round trips, SQL and held-out labels."""

from __future__ import annotations

import hashlib
import io
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import plain, rows_of
from rowtide.llm import chat, components, decontaminate, entry, language, packing, simhash, substring, toxicity, urllists, vafile, warc

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(ROOT)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return c


@needs_tables
@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_same_as_sql(spark, con, name):
    got, want = entry.QUERIES[name](spark, ROOT), con.sql(entry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    expected = [tuple(plain(r[i]) for i in place) for r in want.fetchall()]
    assert rows_of(got, cols) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    data = [(i, t, "x", 1, 2, 3.0) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, ord long, key long, score double")


# -- 1 -----------------------------------------------------------------------------------------


def brute_repeats(rows, size):
    words = [(2**63 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, w in words:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (own, _) in zip(words, rows):
        gone = {j for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < i for j in range(s, s + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("anchor_rows", [1, 10_000])
def test_repeats_like_brute_force(spark, anchor_rows):
    rng = random.Random(anchor_rows)
    rows = [(i, " ".join(rng.choice("ab" if i % 3 else "abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 40), (102, "b " * 9), (103, "a\n" * 70), (103, "a\n" * 70), (None, "a " * 20), (104, "é " * 3000), (105, "é " * 12)]
    got = substring.kept_words(docs_of(spark, rows), size=8, anchor=3, anchor_rows=anchor_rows, shard_words=200, texts=False)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows, 8)


def test_repeats_are_cut_from_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one\n{passage} end"), (2, f"two  {passage}\tfin"), (3, "a  b\nc")]
    got = substring.without_repeats(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "ord", "key", "score"]
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "two fin", 3: "a  b\nc"}
    assert substring.kept_words(docs_of(spark, rows).where("false")).collect() == []


# -- 10 ----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("bucket_rows", [2, 2**17])
def test_near_duplicates_like_brute_force(spark, bucket_rows):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.sample(range(400), 30))]
    rows += [(50 + i, " ".join(f"Y{rng.randint(0, 99)}" for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n"), (202, "a"), (203, "É é"), (204, "é é"), (None, "a")]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    ids = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = [(rows[i][0], fps[i] - 2**64 if fps[i] >= 2**63 else fps[i], ids[root[i]]) for i in range(len(rows))]
    got = simhash.near_duplicates(docs_of(spark, rows), bucket_rows=bucket_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs_of(spark, rows).where("false")).collect() == []


def test_thresholds_cover_every_pair():
    sample = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for count in (500, 10**6, 10**9):
        plan = simhash.plan_probes(sample, count, 3)
        m = max(2, len(plan))
        assert sum(t + 1 for _, t in plan) >= 4 and m <= 6
        rng = random.Random(count)
        for _ in range(300):
            change = sum(1 << b for b in rng.sample(range(64), 3))
            assert any((change & mask).bit_count() <= t for mask, t in plan)
    assert simhash.allocate([[5, 9], [1, 2], [1, 50]], 0) == (3.0, [-1, 1, 0])


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in [100, *range(200, 230)]}) == 1 and len(set(got.values())) == 2


# -- 9 -----------------------------------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(2)
    rows = [(i, i % 4 == 0, rng.choice(["women", "men"])) for i in range(n)]
    texts = [(i, " ".join(rng.choice(["the", "of", "and", "house"]) for _ in range(30)) + (f" vile{'abcdef'[i % 6]} people. {g if i % 8 else 'women'} walk." if bad else f" people. {g if rng.random() < 0.2 else 'they'} walk.")) for i, bad, g in rows]
    return docs_of(spark, texts), spark.createDataFrame([(i, int(bad), 9) for i, bad, _ in rows], "doc_id long, toxic int, quality int")


def test_toxicity_finds_stems_and_ignores_identity(spark):
    docs, labels = labelled(spark)
    fair, free = toxicity.fit(docs, labels, fair=10.0), toxicity.fit(docs, labels, fair=0.0)
    score = lambda m, t: m.score(t, {})
    gap = lambda m: abs(score(m, "women walk") - score(m, "men walk"))
    assert score(fair, "the vilezz house") > 0.5 > 0.3 > score(fair, "the house of they")
    assert gap(fair) < 0.01
    extra = docs_of(spark, [(None, None), (900, ""), (901, "the vilea people " * 5000), (901, "the house")])
    kept = toxicity.without_toxic(docs.unionByName(extra), labels).where("doc_id is null or doc_id >= 900")
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == [(900, ""), (901, "the house"), (None, None)]
    nothing = toxicity.fit(docs, labels.where("false"))
    assert nothing.score("vilea", {}) < 0.01


def test_swaps_count_sentences():
    assert toxicity.swaps("Women came. The women left! Nobody", [("women", "men")]) == {("women", "men"): 2}


# -- 5 -----------------------------------------------------------------------------------------


def test_contained_items(spark):
    words = [f"w{i}" for i in range(25)]
    item = " ".join(words)
    filler = " ".join(f"f{i}" for i in range(500))
    near = " ".join(words[:23] + ["x", "y"])
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, f"{filler} {near}"), (3, "again"), (4, None), (5, ""), (None, item), (6, " ".join(words[:12])), (7, (filler + " ") * 40 + item)]
    items = spark.createDataFrame([(10, item, 1), (10, item, 1), (11, "w1 w2", 1), (12, None, 1)], "item_id long, text string, n int")
    for bound in (0, 1000):
        got = decontaminate.contained(docs_of(spark, rows), items, broadcast_rows=bound)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 10, 21, 21, 1.0), (3, 10, 21, 19, 19 / 21), (7, 10, 21, 21, 1.0), (None, 10, 21, 21, 1.0)], key=str)
    left = decontaminate.without_contaminated(docs_of(spark, rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6]
    assert decontaminate.contained(docs_of(spark, rows), items.where("false")).collect() == []


# -- 4 -----------------------------------------------------------------------------------------


def test_tokens_are_the_tokenizers():
    want, got, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Tokens(packing.vocabulary()), random.Random(4)
    parts = ["a", "ed", " ", "\n", "\t", "é", "'s", "1", ".", "<|endoftext|>", "漢", "\xa0", " the", "😀", "\r\n", "\x1c"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert want.encode(text, add_special_tokens=False).ids == np.frombuffer(got.encode(text), "<u2").tolist()


def test_packing_covers_every_id_once(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "une", "ist", "lorem"]) for _ in range(rng.choice([0, 5, 900])))) for i in range(30)] + [(40, None), (41, "x " * 9000), (41, "x"), (None, "y")]
    got = packing.pack(docs_of(spark, rows), size=256).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = sorted((str(i), tuple(coder.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_doc: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).extend(np.frombuffer(r.ids, "<u2").tolist())
    assert sorted((d, tuple(ids)) for (d, _), ids in by_doc.items()) == whole
    lengths = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in lengths.values()) and max(lengths) + 1 == len(lengths)
    assert packing.pack(docs_of(spark, rows).where("false")).collect() == []


def test_hilbert_curve_is_one_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# -- 3, 2, 7, 8, 6 -----------------------------------------------------------------------------


def test_top_k_like_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.integers(-3, 4, 5).astype(float).tolist(), 1) for i in range(90)] + [(i, [1.0] * 5, 1) for i in range(90, 130)]
    data += [(200, None, 1), (201, [1.0, None, 1.0, 1.0, 1.0], 1), (202, [float("nan")] * 5, 1), (203, [], 1), (None, [1.0] * 5, 1), (204, [9.0], 1)]
    rows = vafile.integers(spark.createDataFrame(data, "vec_id long, embedding array<float>, score int"), 1)
    got = vafile.top_k(rows, rows.where("vec_id % 20 = 0"), k=7, block_rows=20, query_rows=3)
    good = {i: np.array(v) for i, v, _ in data[:130]}
    want = []
    for q in range(0, 130, 20):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == want
    assert vafile.top_k(rows, rows.where("false")).collect() == []


def test_chat_round_trip():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end|>", "<|im_end|>", "<|im_start|>", "\n", "a"]) for _ in range(7))
        role = "".join(rng.choice(["%", "%0A", "\n", "<|", "a", "25"]) for _ in range(4))
        assert "<|im" not in chat.escape(text) and chat.read_turns(chat.turn_text(role, text) * 2) == [(role, text)] * 2


def test_chat_examples(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "a<|im_end|>b", 1), (1, 2, "user", None, 1), (1, 3, "assistant", "c", 1), (2, 0, None, "alone", 1), (None, None, "assistant", "z", 1), (3, 0, "assistant", "é" * 50_000, 1)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int"))
    got = sorted(((r.conv_id, r.example, r.loss_start and chat.unescape(r.formatted[r.loss_start : r.loss_start + r.loss_chars])) for r in made.collect()), key=str)
    assert got == sorted([(1, 0, "a<|im_end|>b"), (1, 1, "c"), (2, 0, None), (None, 0, "z"), (3, 0, "é" * 50_000)], key=str)
    read = {r.conv_id: r for r in chat.digests(made).collect()}
    assert (read[1].n_turns, read[1].loss_sha256) == (4, hashlib.sha256("a<|im_end|>bc".encode()).hexdigest())
    assert (read[2].n_turns, read[2].loss_chars) == (1, 0)


def test_forward_sums_all_segmentations():
    pieces = {"▁a": (0.5, 0.1), "b": (0.2, 0.1), "▁ab": (0.25, 0.5), "▁": (0.05, 0.3), "a": (0.1, 0.1)}
    got = np.exp(language.forward("ab", language.lookup(pieces), 2))
    assert np.allclose(got, [0.25 + 0.5 * 0.2 + 0.05 * 0.1 * 0.2, 0.5 + 0.1 * 0.1 + 0.3 * 0.1 * 0.1])
    used = dict(language.expected("ab", {p: v[0] for p, v in pieces.items()}, 3))
    assert np.isclose(used["▁ab"], 0.25 / 0.351)


@needs_tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = language.fit(docs)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count() > 0
    odd = language.identify(docs_of(spark, [(1, None), (2, "12 34 !"), (None, "the and of that with"), (3, "x" * 5000)]), model)
    got = {r.doc_id: (r.lang_pred, 0 <= r.score <= 1) for r in odd.collect()}
    assert got[1] == got[2] == ("und", True) and got[None][0] == "en" and got[3][1]
    assert language.fit(docs.where("false")).predict("the") == ("und", 0.0)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "long " * 50
    rows = [(1, "http://a/ b\r\nX: y", big, 1), (2, "u", big, 1), (3, None, "tiny", 1), (4, "u", "tiny", 1), (5, "u", None, 1), (6, "u", "", 1), (None, "u", big, 1), (2, "u", big, 1), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives = warc.write(pages, str(tmp_path / "w"), archive_bytes=500)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(archives).collect()), key=str)
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if h == big and i != 1 else ("response", None))) for i, _, h, _ in rows]
    assert got == sorted(want, key=str)
    with open(archives.first().path, "rb") as f:
        data = f.read()
    assert int.from_bytes(data[:4], "little") == warc.MAGIC and len(list(warc.read_archive(io.BytesIO(data)))) > 0
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    assert warc.read(warc.write(pages.where("false"), str(tmp_path / "e"))).collect() == []


def test_url_lists(spark):
    log = [("a", "x.org", "add", 100), ("a", "x.org", "remove", 200), ("a", "x.org", "add", 90_000), ("b", "X.org", "add", 150), ("b", "w.x.org", "add", 0), ("a", "x.org", "add", 100), ("c", "x.org", "add", 300), ("c", "x.org", "remove", 300), (None, "x.org", "add", 1), ("d", "x.org", "note", 1)]
    asked = [(1, "http://w.x.org/p", 99), (2, "http://u@x.org:80/", 100), (3, "https://W.X.ORG?q", 199), (4, "http://x.org", 200), (5, "http://x.org", 100_000), (6, None, 150), (7, "http://x.org", None), (8, "http://yx.org", 150), (None, "http://x.org", 100), (2, "http://u@x.org:80/", 100)]
    entries = spark.createDataFrame(log, "list string, domain string, action string, at long")
    captures = spark.createDataFrame([(*r, 1) for r in asked], "page_id long, url string, fetched long, cell int")
    for cell in (50, 86_400):
        got = urllists.active_entries(captures, entries, cell)
        assert sorted(((r.page_id, r.n_active, r.lists) for r in got.collect()), key=str) == sorted([(1, 1, "b"), (2, 1, "a"), (3, 3, "a,b"), (4, 1, "b"), (5, 2, "a,b"), (6, 0, ""), (7, 0, ""), (8, 0, ""), (None, 1, "a"), (2, 1, "a")], key=str)
    assert urllists.active_entries(captures, entries.where("false")).where("blocked").count() == 0
    assert urllists.active_entries(captures.where("false"), entries).collect() == []


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, ROOT)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= docs.count()
        docs = corpus_pipeline.keep(after, name)
    want = {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, ROOT).collect()} == want
