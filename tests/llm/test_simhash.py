import random

import numpy as np
import pytest
import xxhash
from frames import clashing, documents, rows

from pagesift.llm import simhash
from pagesift.llm.components import are_stars, components

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    """id -> (fingerprint, component, links) by comparing all pairs of fingerprints."""
    prints = {(d, t): brute_print(t) for d, t in docs}
    distinct = sorted(set(prints.values()))
    leader = {p: p for p in distinct}

    def top(p):
        while leader[p] != p:
            p = leader[p]
        return p

    links = dict.fromkeys(distinct, 0)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                leader[top(a)] = top(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return sorted(((d, f"{p:016x}", least.get(top(p)), links[p]) for (d, _), p in prints.items()), key=repr)


def test_every_word_has_one_code_word():
    table = simhash.homes()
    assert len(table) == 1 << 23 and set(np.bincount(table).tolist()) == {2048} and table.max() == 4095


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_keys_meet_for_every_pattern_of_errors(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.int64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, errors, replace=False):
            b[i] ^= np.int64(np.uint64(1) << np.uint64(bit)) if bit < 63 else np.int64(-(1 << 63))
    near = {}
    for key, owner in zip(*simhash.near_keys(b), strict=True):
        near.setdefault(int(owner), set()).add(int(key))
    home = {}
    for key, owner in zip(*simhash.home_keys(a), strict=True):
        home.setdefault(int(owner), set()).add(int(key))
    assert all(home[int(x)] & near[int(y)] for x, y in zip(a, b, strict=True))
    assert max(map(len, near.values())) <= 108


def test_matches_all_pairs_on_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    docs = list(enumerate(texts))
    got = rows(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == brute(docs)
    assert any(links > 1 for *_, links in got)


def test_awkward_rows(spark):
    texts = [None, "", " \t\n", "one", "one two", "ONE TWO", "é É three", "x " * 50_000, "a b c d", "one two"]
    docs = documents(spark, texts, 10)
    docs = docs.unionByName(docs.filter("doc_id = 13")).unionByName(documents(spark, ["lonely text"]).selectExpr("null as doc_id", "text", "lang", "source", "n_chars"))
    got = rows(simhash.near_duplicates(clashing(docs)))
    want = brute(list(zip(range(10, 20), texts, strict=True)) + [(None, "lonely text")])
    assert got == sorted([*want, next(w for w in want if w[0] == 13)], key=repr)
    assert {g[1] for g in got if g[0] in (10, 11, 12)} == {"0" * 16}
    assert rows(simhash.near_duplicates(docs.limit(0))) == []


def test_a_crowded_fingerprint_is_dealt_into_parts(spark):
    data = [(i, None if i % 3 == 0 else f"some words {i % 40} of text {i % 40}") for i in range(1200)]
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == brute(data)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_drop_keeps_columns_and_one_row_of_each_group(spark):
    docs = clashing(documents(spark, ["a b c d", "a b c d", "w x y z", None, ""]))
    docs = docs.unionByName(docs.filter("doc_id = 1").selectExpr("null as doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert rows(left, "doc_id") == [(1,), (3,), (4,)]
    # Without ids, or with ids that repeat: still one row of each group, and every group keeps one.
    data = [(None, "a b c d"), (None, "a b c d"), (None, "a  b c d"), (7, "w x y z"), (7, "k l m n"), (7, "k l m n"), (None, "k l m n")]
    left = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.text.split()[0]) for r in left.fillna(-1, "doc_id").collect()) == [(-1, "a"), (7, "k"), (7, "w")]
    assert simhash.drop_near_duplicates(docs.limit(0)).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """The plans of all tables that simhash writes between its steps."""
    plans = []
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: (plans.append(plan_of(df)), cut(df))[1])
    return plans


@pytest.mark.parametrize("operator", [simhash.drop_near_duplicates, simhash.near_duplicates])
def test_keys_are_not_broadcast(spark, written, operator):
    """A fingerprint becomes up to 108 keys, which the size of its file does not tell."""
    operator(spark.createDataFrame([(i, f"some words {i} of text {i}") for i in range(300)], "doc_id bigint, text string"))
    keys = [plan for plan in written if "MapInArrow" in plan]
    assert len(keys) == 1 and "SortMergeJoin" in keys[0] and "Broadcast" not in keys[0]


@pytest.mark.parametrize("copies", [1, 3])
def test_documents_are_not_broadcast(spark, copies):
    """Nor are fingerprints; with three copies of most texts, one of them is crowded and dealt into parts."""
    data = [(i, "one text" if copies > 1 and i % 2 else f"some words {i // copies} of text {i // copies}") for i in range(600)]
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert ("_part" in plan_of(found)) == (copies > 1)
    assert plan_of(found).count("SortMergeJoin") == 2 and "Broadcast" not in plan_of(found)
    assert rows(found) == brute(data)
    assert "Broadcast" not in plan_of(found)  # nor as the joins were planned anew on the way


def test_a_crowded_centre(spark):
    """Stars are told from other graphs; one node has most of the links."""
    star = [(i, 0) for i in range(1, 2000)]
    assert are_stars(spark.createDataFrame(star, "u int, v int"))
    for more in ((5, 4), (0, -1), (2001, 7)):
        assert not are_stars(spark.createDataFrame([*star, more], "u int, v int"))
    edges = [(1000, i) for i in range(1, 3000) if i != 1000] + [(5000 + i, 5001 + i) for i in range(20)]
    got = dict(rows(components(spark.createDataFrame(edges, "a int, b int")), "node", "component"))
    assert got == {**{i: 1 for i in range(1, 3000)}, **{i: 5000 for i in range(5000, 5021)}}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    leader = {}

    def top(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            leader[hi] = lo
    want = sorted(((x, top(x)) for x in leader), key=repr)
    frame = spark.createDataFrame([*edges, (None, 3), (9, None)], "a bigint, b bigint")
    assert rows(components(frame), "node", "component") == want
    assert components(frame.limit(0)).isEmpty()
