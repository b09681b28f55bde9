import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import SCHEMA, clashing
from pyspark.sql import functions as F

from pagesift.llm import mixing
from pagesift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SMALL = mixing.Settings(block_words=16, shard_words=400)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight, cut at the caps, share the excess anew, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def checked(data, report, settings):
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(words(t))
    want = targets(sizes, settings.weights, settings.share, settings.most)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in report) == Counter(
        (d, len(words(t)), sizes[s], round(want[s], 6)) for d, t, s in data
    )
    taken = Counter()
    source_of = {d: s for d, _, s in data}
    for r in report:
        assert 0 <= r.taken <= settings.most * r.size
        taken[source_of[r.doc_id]] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.5


def corpus(n=300):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        source = ["hot", "b", None, "", "é", "only empty"][int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.05, 0.1, 0.05]))]
        many = 0 if source == "only empty" else int(rng.integers(0, 30))
        text = "".join(f"w{i}x{k}" + rng.choice([" ", "\n", "  ", "\t"]) for k in range(many))
        out.append((i, None if i % 50 == 0 else text, source))
    return [*out, (1000, " ".join(f"long{k}" for k in range(3000)), "b")]


def frame(spark, data):
    return spark.createDataFrame([(d, t, None, s, None) for d, t, s in data], SCHEMA)


@pytest.fixture(scope="module")
def made(spark):
    data = corpus()
    return data, mixing.mix_texts(clashing(frame(spark, data).repartition(5)), SMALL).collect()


def test_report(spark):
    data = corpus()
    docs = clashing(frame(spark, data).repartition(3))
    report = mixing.mix_report(docs, SMALL).collect()
    checked(data, report, SMALL)
    again = mixing.mix_report(docs.repartition(6), SMALL).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, report))
    other = mixing.mix_report(docs, mixing.Settings(block_words=16, shard_words=400, seed="other")).collect()
    assert Counter(map(tuple, other)) != Counter(map(tuple, report))


@pytest.mark.parametrize("settings", [
    mixing.Settings(weights=(1.0,), share=1.9, block_words=7, shard_words=1 << 30),
    mixing.Settings(weights=(0.0, 5.0), share=3.0, block_words=10_000),
    mixing.Settings(weights=(1.0, 9.0), share=0.01, most=1, block_words=1, shard_words=3),
])
def test_settings(spark, settings):
    data = corpus(60)
    report = mixing.mix_report(frame(spark, data), settings).collect()
    if settings.share < settings.most and all(settings.weights):
        return checked(data, report, settings)
    number = {s: i for i, s in enumerate(sorted({s for *_, s in data}, key=lambda s: (s is None, s or "")))}
    source_of = {d: s for d, _, s in data}
    assert all(r.taken == (2 * r.size if number[source_of[r.doc_id]] % 2 else 0) for r in report)


def test_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    checked(data, QUERIES["op11_mixing"](spark, SF).collect(), mixing.Settings())


def test_shards(made):
    """Every draw lies in one shard; shards have equal numbers of blocks; texts are the documents' own words."""
    data, mix = made
    text_of = {d: words(t) for d, t, _ in data}
    taken, blocks, seen = Counter(), defaultdict(set), set()
    for r in mix:
        assert words(r.text) == text_of[r.doc_id][r.first_word : r.first_word + r.n_words]
        here = [(r.no, r["pass"], r.doc_id, k) for k in range(r.first_word, r.first_word + r.n_words)]
        assert seen.isdisjoint(here)
        seen.update(here)
        taken[r.shard] += r.n_words
        blocks[r.shard].add(r.slot)
    total = sum(taken.values())
    assert len(taken) == -(-total // SMALL.shard_words)
    counts = [len(blocks[k]) for k in sorted(blocks)]
    assert max(counts) - min(counts) <= 1 and all(blocks[k] == set(range(len(blocks[k]))) for k in blocks)
    # Within a slot the words follow each other.
    by_slot = defaultdict(list)
    for r in mix:
        by_slot[r.shard, r.slot].append((r.nth, r.n_words, r.no))
    for parts in by_slot.values():
        parts.sort()
        assert parts[0][0] == 0 and len({p[2] for p in parts}) == 1
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_whole_passes_repeat_every_text(made):
    data, mix = made
    passes = defaultdict(lambda: defaultdict(dict))
    for r in mix:
        passes[r.no, r["pass"]][r.doc_id][r.first_word] = r.text
    number = {s: i for i, s in enumerate(sorted({s for *_, s in data}, key=lambda s: (s is None, s or "")))}
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(words(t))
    whole = 0
    for s, target in targets(sizes).items():
        for p in range(int(target // sizes[s]) if sizes[s] else 0):
            whole += 1
            for d, t, source in data:
                if source == s and words(t):
                    found = passes[number[s], p][d]
                    assert "".join(found[k] for k in sorted(found)) == re.sub(r"[\x20\x09-\x0D]+$", "", t)
    assert whole > 0


def test_tree_gives_exact_and_fair_quotas(spark):
    quotas = spark.createDataFrame([(0, 40_000), (1, 9000), (2, 0), (3, 1001)], "no long, draws long").filter("draws > 0")
    rows = mixing.split(quotas, 50_001, 700, "seed").collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.no] += r.draws
        by_shard[r.shard] += r.draws
    assert by_source == {0: 40_000, 1: 9000, 3: 1001}
    assert all(by_shard[k] == (k + 1) * 50_001 // 700 - k * 50_001 // 700 for k in range(700))
    # A shard of 71 blocks is a sample of the whole: mean and variance of the hypergeometric distribution.
    got = np.array([next((r.draws for r in rows if r.shard == k and r.no == 1), 0) for k in range(700)])
    p = 9000 / 50_001
    assert got.mean() == pytest.approx(9000 / 700) and got.var() == pytest.approx(71.4 * p * (1 - p), rel=0.25)


def test_split_of_more_blocks_than_numpy_draws(monkeypatch):
    random = np.random.default_rng(0)
    huge = np.array([7 * 10**12 + 1, 0, 5, 3 * 10**12 + 2])
    left = mixing.left_part(huge, 10**12 + 3, random)
    assert left.sum() == 10**12 + 3 and (left >= 0).all() and (left <= huge).all()
    monkeypatch.setattr(mixing, "LARGEST_DRAW", 10)
    for _ in range(200):
        quotas = random.integers(0, 9, 6)
        many = int(random.integers(0, quotas.sum() + 1))
        left = mixing.left_part(quotas, many, random)
        assert left.sum() == many and (left >= 0).all() and (left <= quotas).all()


def test_empty_and_awkward_tables(spark):
    nothing = frame(spark, [])
    assert mixing.mix_report(nothing).isEmpty() and mixing.mix_texts(nothing).isEmpty()
    blank = frame(spark, [(1, None, None), (1, " \n", "a"), (None, "", "a")])
    assert sorted(tuple(r) for r in mixing.mix_report(blank).fillna(-1, "doc_id").collect()) == [(-1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    assert mixing.mix_texts(blank).isEmpty()
    same = frame(spark, [(None, "a b c", "s")] * 40 + [(7, "x " * 50_000, "s"), (7, "y", None)])
    report = mixing.mix_report(same).collect()
    assert len(report) == 42 and all(r.taken <= 2 * r.size for r in report)
    assert abs(sum(r.taken for r in report) - 1.5 * (120 + 50_000 + 1)) <= 1


def test_written_shards(spark, tmp_path):
    mix = mixing.mix_texts(frame(spark, corpus(40)), SMALL)
    mixing.write_shards(mix, f"file://{tmp_path}/mix")
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    assert back.count() == mix.count() and back.agg(F.sum("n_words")).first() == mix.agg(F.sum("n_words")).first()
