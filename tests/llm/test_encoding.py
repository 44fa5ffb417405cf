"""Encoding, alignment and the manifest against the tokenizers' libraries and plain Python."""

from __future__ import annotations

import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from rowtide.llm import align, bpe, merkle

PARTS = ["a", "ed", " ", "  ", "\n", "\t", "é", "'s", "'LL", "1", "12", ".", "<|endoftext|>", "<|startoftext|>", "<|", "<s>", "<0x41>", "漢", "\xa0", " the", "😀", "\r\n", "\x1c", "İ", "½", "Σ", "ά", "é", "\x85", "हिन्दी", "▁", "\x00", "ouréaux"]


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS[:-3] if k % 3 else PARTS) for _ in range(rng.randint(0, 14))) for k in range(n)]


def frame(spark, rows):
    """Documents with extra columns under the names that the operators use themselves."""
    data = [(i, t, 1, "x", 2, 3) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, ids int, chunk string, pairs int, pos int")


def digest(text):
    return sha256(text.encode()).hexdigest()


# -- 11 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def test_ids_are_the_librarys(library):
    own = bpe.coder(bpe.vocabulary())
    for text in some_texts(1, 6000):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 50_000, "é" * 30_000, "漢字" * 20_000, "!" * 50_000, " " * 1_000_000, "\n" * 1_000_000])
def test_long_words(library, text):
    assert bpe.coder(bpe.vocabulary()).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_memo_forgets_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Bpe(bpe.vocabulary())
    for text in ["one two three four five", "five one six", "two two one", "x" * 100]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_merging_takes_the_leftmost_of_equal_pairs():
    own = bpe.coder(bpe.vocabulary())
    a = own.vocab["a"]
    assert len(own.merge([a] * 7)) < 7 and own.merge([]) == [] and own.merge([a]) == [a]


def test_decoding_joins_strings_and_skips_unknown_ids(library):
    own = bpe.coder(bpe.vocabulary())
    assert own.decode([49407, 10**9, -1, own.vocab["in"]]) == "<|endoftext|> in"


def test_encoded_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello wörld"), (4, "Hello wörld"), (4, "again"), (None, "x"), (5, "long words " * 20_000)]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    docs = frame(spark, rows)
    coded = bpe.encode(docs)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == sorted(want, key=str)
    read = bpe.decode(coded.withColumnRenamed("doc_id", "x").withColumnRenamed("x", "doc_id"))
    assert sorted(((r.doc_id, r.text) for r in read.collect()), key=str) == sorted([(i, library.decode(x, skip_special_tokens=False)) for i, x in want], key=str)
    told = [(i, len(x), digest(" ".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for i, x in want]
    assert sorted(map(tuple, bpe.digests(docs).collect()), key=str) == sorted(told, key=str)
    assert bpe.digests(docs.where("false")).collect() == [] == bpe.encode(docs.where("false")).collect()


# -- 12 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    return align.coders(*align.vocabularies())


def whole_ids(coders, text):
    """Both sides of a whole text by the libraries; none if either does not give it back."""
    if not text:
        return [], []
    a, b, spaced = coders.any.encode(" " + text, add_special_tokens=False).ids, coders.pieces.encode(text), (" " + text).encode()
    good = b"".join(coders.a_bytes[i] for i in a) == spaced == b"".join(coders.b_bytes[i] for i in b)
    return (a, b) if good else ([], [])


def brute_links(a_ends, b_ends):
    a, b = [0, *a_ends], [0, *b_ends]
    return sorted((i, j) for i in range(len(a_ends)) for j in range(len(b_ends)) if max(a[i], b[j]) < min(a[i + 1], b[j + 1]))


def plain_groups(a, b, cuts):
    out, i, j = [], 0, 0
    for x, y in cuts:
        out.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return ";".join(out)


def test_stretches_give_the_ids_of_whole_texts(coders):
    for text in some_texts(2, 6000):
        assert tuple(x.tolist() for x in coders.ids(text)) == whole_ids(coders, text) if text else True, text


@pytest.mark.parametrize("seed", range(40))
def test_runs_and_irregular_groups(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 3, 9, 60, 400])
    both = sorted(rng.sample(range(1, 20 * size), size))
    odd = rng.choice([0.0, 0.02, 0.5, 1.0])
    a = sorted({*[x for x in both if rng.random() > odd / 2], *rng.sample(range(1, 20 * size), int(odd * size / 2)), 20 * size})
    b = sorted({*[x for x in both if rng.random() > odd / 2], 20 * size})
    found = align.align(np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in found.a_cuts] == common == [b[i - 1] for i in found.b_cuts]
    assert sorted(zip(found.a_links.tolist(), found.b_links.tolist())) == brute_links(a, b)


def test_links_come_in_order_and_groups_as_bytes(coders):
    found = align.align(np.array([1, 2, 5, 6, 9]), np.array([1, 3, 4, 5, 6, 8, 9]))
    assert list(zip(found.a_links.tolist(), found.b_links.tolist())) == [(0, 0), (1, 1), (2, 1), (2, 2), (2, 3), (3, 4), (4, 5), (4, 6)]
    a, b = coders.ids("Ein Wort, zwei längere Wortungetüme  und\n42")
    found = align.align(np.cumsum(coders.a_sizes[a]), np.cumsum(coders.b_sizes[b]))
    cuts = list(zip(found.a_cuts.tolist(), found.b_cuts.tolist()))
    assert align.group_text(coders, a, b, found) == plain_groups(a.tolist(), b.tolist(), cuts).encode()
    assert len(coders.a_bytes) > 40_000 and len(cuts) > 5


def test_no_tokens_no_groups():
    empty = np.array([], np.int64)
    assert all(len(x) == 0 for x in align.align(empty, empty))


def brute_token_links(coders, rows):
    made = []
    for i, text in rows:
        a, b = whole_ids(coders, text)
        a_ends, b_ends = np.cumsum(coders.a_sizes[a]).tolist() if a else [], np.cumsum(coders.b_sizes[b]).tolist() if b else []
        cuts = [(a_ends.index(e) + 1, b_ends.index(e) + 1) for e in sorted(set(a_ends) & set(b_ends))]
        links = [(a[x], b[y]) for x, y in brute_links(a_ends, b_ends)]
        made.append((i, len(a), len(b), len(cuts), links, digest(plain_groups(a, b, cuts)) if a else ""))
    count: dict = {}
    for row in made:
        for pair in row[4]:
            count[pair] = count.get(pair, 0) + 1
    most: dict = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(i, na, nb, g, len(links), told, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for i, na, nb, g, links, told in made]


@pytest.mark.parametrize("chunk_links", [1, 50, 10**6])
def test_token_links_like_brute_force(spark, coders, chunk_links):
    rows = list(enumerate(some_texts(3, 60))) + [(100, None), (101, ""), (102, "▁"), (103, "Hello there, wörld"), (103, "Hello there, wörld"), (103, "other"), (None, "a b"), (104, "the end\n" * 60)]
    got = align.token_links(frame(spark, rows).repartition(5), chunk_links=chunk_links)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_token_links(coders, rows), key=str)


def test_alignments(spark, coders):
    rows = [(1, "Hello there, wörld"), (2, None), (2, "x ▁"), (3, "word " * 40_000), (4, "\n" * 300_000)]
    for r in align.alignments(frame(spark, rows)).collect():
        text = dict([(1, rows[0][1]), (3, rows[3][1]), (4, rows[4][1])]).get(r.doc_id)
        a, b = whole_ids(coders, text)
        assert (r.a_ids, r.b_ids) == (a, b) and len(r.a_cuts) == len(r.b_cuts)
        assert np.cumsum(coders.a_sizes[a])[np.array(r.a_cuts, int) - 1].tolist() == np.cumsum(coders.b_sizes[b])[np.array(r.b_cuts, int) - 1].tolist() if a else r.a_cuts == []
    assert align.token_links(frame(spark, rows).where("false")).collect() == []


# -- 13 ----------------------------------------------------------------------------------------


def plain_leaf(doc_id, source, lang, n_chars, text):
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def plain_tree(leaves):
    """Root and, for each leaf, its siblings with their side."""
    met, place, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, at in enumerate(place):
            other = at ^ 1
            if other < len(nodes):
                met[k].append((other < at, nodes[other]))
            else:
                met[k].append((None, ""))
            place[k] = at >> 1
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], met


def brute_manifest(rows):
    trees: dict = {}
    for doc_id, source, lang, n_chars, text in rows:
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, plain_leaf(doc_id, source, lang, n_chars + 1, text) if hit else own, doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {x: plain_tree([r[2] for r in sorted(trees[x])]) for x in langs}
    root, tops = plain_tree([subs[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (_, _, own, claim, doc_id), met in zip(sorted(trees[lang]), subs[lang][1]):
            path, folded = met + top, claim
            for left, other in path:
                folded = digest(other + folded if left else folded + other)
            out.append((doc_id, own, subs[lang][0], root, digest("".join(d for _, d in path)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["web", None, "é"]), rng.choice(["en", "en", "en", "fr", None, "", "漢"]), rng.choice([None, i, 2**63 - 1]), rng.choice([None, "", "-", "text é"])) for i in range(n)]
    return rows + [(3, "a", "en", 1, "t"), (3, "a", "en", 1, "t"), (None, None, None, None, None), (None, "x", "en", 7, "y"), (7, "s", "only", 1, "z" * 500_000)]


def digest_columns(df):
    from pyspark.sql import functions as F

    met = F.array_join(F.transform("proof", lambda s: F.regexp_replace(s, "^[LR-]", "")), "")
    return df.select("doc_id", "leaf", "subroot", "root", F.sha2(met, 256), "folded_root", "verified")


@pytest.mark.parametrize("n, levels", [(90, 2), (90, 9), (260, 1), (0, 3)])
def test_manifest_like_brute_force(spark, n, levels):
    rows = manifest_rows(n)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, digest string").repartition(4)
    got = merkle.document_manifest(docs, levels)
    assert sorted(map(tuple, digest_columns(got).collect()), key=str) == brute_manifest(rows)


def test_small_manifests(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(14, "s", "en", 1, "t")]
    assert sorted(map(tuple, digest_columns(merkle.document_manifest(spark.createDataFrame(one, schema))).collect()), key=str) == brute_manifest(one)
    assert merkle.document_manifest(spark.createDataFrame([], schema)).collect() == []


def test_proofs_fold_to_the_root_alone(spark):
    rows = manifest_rows(40)
    made = merkle.document_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), 2).collect()
    assert all(merkle.fold(r.leaf, r.proof) == r.root for r in made) and any(not r.verified for r in made)


needs_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


@needs_tables
def test_documents_encode_like_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.query(spark, "/root/testdata/sf0.001").collect()} == {i: (len(x), digest(" ".join(map(str, x)))) for i, x in want.items()}


@needs_tables
def test_documents_align_like_brute_force(spark, coders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()]
    got = align.token_links(docs.where("length(text) < 4000"))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == brute_token_links_fast(coders, rows)


def brute_token_links_fast(coders, rows):
    """As ``brute_token_links``, walking both sides at once."""
    made, count = [], {}
    for i, text in rows:
        a, b = whole_ids(coders, text)
        links, cuts, x, y, at, bt = [], [], 0, 0, 0, 0
        while x < len(a):
            links.append((a[x], b[y]))
            at_end, bt_end = at + int(coders.a_sizes[a[x]]), bt + int(coders.b_sizes[b[y]])
            if at_end <= bt_end:
                x, at = x + 1, at_end
            if bt_end <= at_end:
                y, bt = y + 1, bt_end
            if at == bt:
                cuts.append((x, y))
        for p in links:
            count[p] = count.get(p, 0) + 1
        made.append((i, len(a), len(b), len(cuts), links, digest(plain_groups(a, b, cuts)) if a else ""))
    most: dict = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return {i: (na, nb, g, len(links), told, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for i, na, nb, g, links, told in made}
