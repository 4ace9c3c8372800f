from __future__ import annotations

import random

import pytest

from tests.llm import brute
from tests.llm.conftest import corpus
from tillgrain.llm.mixing import fair_mix, mixed_documents, sizes_of, targets


def plain_targets(sizes, passes=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    rest, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > passes * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = passes * sizes[s]
            rest -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_water_levels(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 1000, 100_000]) + rng.randint(0, 9) for i in range(9)} | {None: 50, "Z": 7, "é": 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_each_source_gets_its_target(make_docs, scratch):
    rows = corpus(10, 120)
    sized = sizes_of(make_docs(rows), scratch)
    mix, sources = fair_mix(sized, scratch)
    sizes = {r["copy"]: r for r in sized.collect()}
    assert sum(r.size for r in sizes.values()) == sum(len(brute.WORD.findall(t or "")) for _, t, *_ in rows)
    wanted = {r.source: r.target for r in sources.collect()}
    entries = sorted(mix.collect(), key=lambda r: r.position)
    taken, per_copy, at = {}, {}, 0
    for r in entries:
        assert r.position == at and 0 < r.words <= sizes[r["copy"]].size
        at += r.words
        taken[r.source] = taken.get(r.source, 0) + r.words
        per_copy[r["copy"]] = per_copy.get(r["copy"], 0) + r.words
    assert [r.finish for r in entries] == sorted(r.finish for r in entries)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in wanted.items())
    assert all(n <= 3 * sizes[c].size for c, n in per_copy.items())
    again, _ = fair_mix(sized.repartition(5), scratch)
    assert {(r["copy"], r["pass"], r.words) for r in again.collect()} == {(r["copy"], r["pass"], r.words) for r in entries}


def test_whole_documents(make_docs, scratch):
    rows = corpus(11, 120)
    docs = make_docs(rows)
    mixed = mixed_documents(docs, scratch)
    assert mixed.columns == docs.columns
    sizes, taken = {}, {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    longest = max(len(brute.WORD.findall(t or "")) for _, t, *_ in rows)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.WORD.findall(r.text))
    want = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= longest / 2 + 1 for s in want)


def test_nothing_to_mix(make_docs, scratch):
    for rows in ([], [(1, None, None, "s"), (2, "", None, None)]):
        docs = make_docs(rows)
        mix, _ = fair_mix(sizes_of(docs, scratch), scratch)
        assert mix.isEmpty() and mixed_documents(docs, scratch).isEmpty()
