import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import fuzzy
from pagesift.functions.fuzzy import score_adjustment, similarity, weighted_ratio


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def expected(a, b, windowed):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0
    if windowed:
        return round(100 * max(lcs(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1)) / len(a))
    return round(200 * lcs(a, b) / (len(a) + len(b)))


texts = st.text("abc é", max_size=12) | st.text("abcdefgh", min_size=55, max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=8), st.booleans())
def test_kernel_equals_dynamic_programming(pairs, windowed):
    assert similarity(pairs, windowed).tolist() == [expected(a, b, windowed) for a, b in pairs]


def test_kernel_on_a_pattern_of_exactly_64_characters():
    a = "abcdefgh" * 8
    assert similarity([(a, a), (a, a[::-1]), (a, a + "x" * 9)], False).tolist() == [
        100, expected(a, a[::-1], False), expected(a, a + "x" * 9, False),
    ]


GOLDEN = [
    ("Harry Potter", "Harry Potter", 100, 101),
    ("Harry Potter", "Potter Harry", 95, 95),
    ("Batman", "Batman Arkham Knight", 90, 90),
    ("Batman", "Superman", 43, 42),
    ("Cold Widget", "Widget", 90, 59),
    ("Harry Potter", "", 0, -31),
    ("A", "", 0, -31),
    ("", "", 0, 0),
]


@pytest.mark.parametrize("a, b, ratio, score", GOLDEN)
def test_weighted_ratio(spark, a, b, ratio, score):
    row = (
        spark.createDataFrame([(a, b)], "a string, b string")
        .select("a", "b", weighted_ratio(F.col("a"), F.col("b")).alias("r"), weighted_ratio(F.col("b"), F.col("a")).alias("back"))
        .withColumn("s", F.col("r") + score_adjustment(F.col("r"), F.col("a"), F.col("b")))
        .first()
    )
    assert (row.r, row.back, row.s) == (ratio, ratio, score)


def lcs(a, b):
    """With Python integers as bit rows: any length."""
    masks = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@pytest.mark.parametrize("windowed", [False, True])
def test_texts_of_any_length(windowed):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    sizes = [0, 1, 63, 64, 65, 127, 128, 129, 200, 300]
    pairs = [(text(rng.choice(sizes)), text(rng.choice(sizes))) for _ in range(120)] + [("a" * 130, "a" * 400)]
    want = []
    for a, b in pairs:
        a, b = sorted((a, b), key=len)
        if not a:
            want.append(0)
        elif windowed:
            want.append(int(np.rint(100 * max(lcs(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1)) / len(a))))
        else:
            want.append(int(np.rint(200 * lcs(a, b) / (len(a) + len(b)))))
    assert similarity(pairs, windowed).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=4), st.sampled_from([0, 1, 2]), st.booleans())
def test_long_path_equals_dynamic_programming(pairs, most_words, windowed):
    """The path of long texts, taken by short ones: pruned windows, rows of bits cut into blocks."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fuzzy, "_WORDS", most_words)
        patch.setattr(fuzzy, "_WIDTH", 0)
        patch.setattr(fuzzy, "_BLOCK", 7)
        assert similarity(pairs, windowed).tolist() == [expected(a, b, windowed) for a, b in pairs]


@given(texts.filter(len), texts.filter(len))
def test_bounds_of_windows_are_common_characters(a, b):
    a, b = sorted((a, b), key=len)
    codes = [np.array([ord(c) for c in t]) for t in (a, b)]
    common = lambda w: sum(min(a.count(c), w.count(c)) for c in set(a))
    windows = [b[k : k + len(a)] for k in range(len(b) - len(a) + 1)]
    assert fuzzy._common_counts(*codes).tolist() == [common(w) for w in windows]


def test_title_of_20000_characters_in_bounded_memory():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    title = " ".join(rng.choice(vocabulary) for _ in range(4_000))[:20_000]
    piece = title[9_000:14_000]
    query = "".join(rng.choice("xyz") if rng.random() < 0.1 else c for c in piece)
    tracemalloc.start()
    began = time.monotonic()
    got = [similarity([(query, title)], windowed)[0] for windowed in (True, False)]
    took = time.monotonic() - began
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1] == round(200 * lcs(query, title) / 25_000)
    windows = (title[k : k + 5_000] for k in range(8_900, 9_101))
    assert got[0] == round(100 * max(lcs(query, w) for w in windows) / 5_000)
    assert peak < 50e6 and took < 120, (peak, took)


def test_many_short_pairs_beside_a_long_one_do_not_share_its_width():
    pairs = [("abc", "abd")] * 20_000 + [("abc", "x" * 4_000 + "abc")]
    tracemalloc.start()
    assert similarity(pairs, True)[-2:].tolist() == [67, 100]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
