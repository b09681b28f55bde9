import hashlib
import zlib

import pytest
from frames import SCHEMA, clashing, rows
from pyspark.sql import functions as F

from pagesift.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    """Siblings before and after, level by level."""
    out = []
    for nodes in levels[:-1]:
        start = i // 16 * 16
        out.append((nodes[start:i], nodes[i + 1 : start + 16]))
        i //= 16
    return out


def brute(data):
    """data: (doc_id, text, lang, source, n_chars)"""
    sources = {}
    for d, t, lang, s, n in data:
        changed = t is not None and d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if changed else t
        sources.setdefault(s, []).append((d, leaf((d, s, lang, n, t)), leaf((d, s, lang, n, lowered))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(climb([x[1] for x in sources[s]]))
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (d, own, changed) in enumerate(sources[s]):
            path = way(trees[k], i) + way(top, k)
            node = changed
            for before, after in path:
                node = H(*before, node, *after)
            out.append((d, own, trees[k][-1][0], top[-1][0], H(*[x for b, a in path for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def many(n):
    """A hot source of thousands, sources of awkward sizes and names, nulls and repeated rows."""
    data = [(i, f"Text {i}", "en", "hot", i) for i in range(n)]
    for name, size in ((None, 17), ("", 16), ("é", 1), ("z", 257), ("\U0001f600", 2), ("￿", 15)):
        data += [(10_000 + 7 * i, None if i % 5 == 0 else f"{name} {i} ÄB", None, name, None) for i in range(size)]
    data += [(None, "No Id", None, "", 1), (None, "No Id", None, "", 1), (3, "Text 3", "en", "hot", 3), (5, "", "", "z", 0), (-7, "X" * 100_000, "en", "z", 1)]
    return data


def test_many_levels(spark):
    data = many(4200)
    got = merkle.tampered_rows(clashing(frame(spark, data).repartition(7)))
    want = brute(data)
    assert rows(got, *COLUMNS) == want
    assert {x[6] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_of_one_source(spark, n):
    data = [(i, f"Doc {i}", None, None, None) for i in range(n)]
    assert rows(merkle.tampered_rows(frame(spark, data).coalesce(2)), *COLUMNS) == brute(data)


def test_many_sources(spark):
    data = [(i, f"Doc {i}", None, f"s{i // 2}", None) for i in range(600)]
    assert rows(merkle.tampered_rows(frame(spark, data)), *COLUMNS) == brute(data)


def test_empty(spark):
    empty = merkle.tampered_rows(frame(spark, []))
    assert empty.isEmpty() and set(COLUMNS) < set(empty.columns)


def test_versions_share_what_they_do_not_copy(spark):
    data = [(i, f"Doc {i}", None, "ab"[i % 3 == 0], None) for i in range(900)]
    hit = F.col("doc_id").isin(0, 3, 500)
    marked = merkle.leaves(frame(spark, data), edits={"text": F.lower("text")}, where=hit)
    built = merkle.manifest(marked)
    sources = {s: [d for d in data if d[3] == s] for s in "ab"}
    trees = [climb([leaf((d[0], d[3], d[2], d[4], d[1])) for d in sources[s]]) for s in "ab"]
    top = climb([t[-1][0] for t in trees])
    owned = {}
    for r in merkle.versions(built).collect():
        owned.setdefault((r.tree, r.pos), {})[r.level] = r.digest
    assert len(owned) == 3
    for (tree, pos), copies in owned.items():
        d = sources["ab"[tree]][pos]
        nodes = list(trees[tree][0])
        nodes[pos] = leaf((d[0], d[3], d[2], d[4], d[1].lower()))
        changed = climb(nodes)
        height = len(changed) - 1
        upper = list(top[0])
        upper[tree] = changed[-1][0]
        want = {k: changed[k][pos // 16**k] for k in range(height + 1)} | {height + 1: climb(upper)[-1][0]}
        assert copies == want
        # Every node that the version does not own is the base tree's.
        for k, level in enumerate(changed):
            assert [h for i, h in enumerate(level) if i != pos // 16**k] == [h for i, h in enumerate(trees[tree][k]) if i != pos // 16**k]


def test_only_dataframe_code(spark):
    plan = merkle.tampered_rows(frame(spark, many(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
