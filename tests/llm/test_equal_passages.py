"""Passages whose words differ but collide in every hash that op1 meets by."""

from __future__ import annotations

import os
import random
import struct
import sys

import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowtide.llm import substring

P1, P2, ALL = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 2**64 - 1


def colliding_words():
    """Two words of 64 letters with the same xxh64: in one lane the second block undoes the first."""
    rng, back = random.Random(1), pow(P2, -1, 2**64)
    rotated = lambda x: (x << 31 | x >> 33) & ALL
    lane = lambda block: rotated((P1 + P2 + block * P2) & ALL) * P1 & ALL
    letters = lambda: bytes(rng.randint(33, 126) for _ in range(8))
    fill, first, second = b"a" * 24, letters(), letters()
    number = lambda b: struct.unpack("<Q", b)[0]
    while True:
        other = letters()
        need = struct.pack("<Q", (number(second) + (lane(number(first)) - lane(number(other))) * back) & ALL)
        if all(33 <= c <= 126 for c in need):
            return (first + fill + second + fill).decode(), (other + fill + need + fill).decode()


@pytest.mark.parametrize("anchor_rows", [1, 10_000])
def test_words_with_one_hash_are_not_taken_for_equal(spark, anchor_rows):
    a, b = colliding_words()
    assert a != b and xxhash.xxh64_intdigest(a) == xxhash.xxh64_intdigest(b)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [x] + words[30:])) for i, x in enumerate((a, b, a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.kept_words(docs, size=50, anchor_rows=anchor_rows, texts=False)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {0: 0, 1: 0, 2: 61}
