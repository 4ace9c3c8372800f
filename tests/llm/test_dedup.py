from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.conftest import corpus
from tillgrain.llm.chosenpath import drop_near_duplicates, near_duplicates
from tillgrain.llm.components import components
from tillgrain.llm.digests import DigestIndex, drop_exact_duplicates, exact_duplicates
from tillgrain.llm.repeats import rolling, without_repeats
from tillgrain.llm.runindex import RunIndex, without_long_repeats
import tillgrain.llm.chosenpath as chosenpath
import tillgrain.llm.runindex as runindex


def norm(text):
    return (text or "").translate(brute.LOWER)


def test_exact_duplicates(make_docs, scratch):
    rows = corpus()
    found = exact_duplicates(make_docs(rows), scratch).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(norm(text), []).append(i)
    texts = {i: norm(t) for i, t, *_ in rows}
    for r in found:
        group = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size) == (max(group), len(group))
        assert r.text_digest == hashlib.sha256(texts[r.doc_id].encode()).digest()
        assert not r.kept or r.doc_id == max(group)
    assert sum(r.kept for r in found) == len(groups)


def test_exact_dedup_keeps_one_row_of_each_text_and_all_columns(make_docs, scratch):
    docs = make_docs([*corpus(), (None, "one", None, None), (None, "nothing else like it", None, None)])
    kept = drop_exact_duplicates(docs, scratch)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t, *_ in corpus()} | {"nothing else like it"})


def test_digest_index_appends_only_what_is_new(spark, scratch):
    index = DigestIndex(spark, "digests_of_a_test", scratch.folder(), 4)
    rows = lambda *x: spark.createDataFrame([(bytes([d]), i, i) for d, i in x], "text_digest binary, doc_id bigint, row_id bigint")
    index.append(rows((1, 5), (1, 9), (2, 3)))
    index.append(rows((1, 99), (3, 1)))
    index.append(rows((1, 99), (3, 1)))
    assert sorted((r.text_digest[0], r.doc_id) for r in index.read().collect()) == [(1, 9), (2, 3), (3, 1)]
    anti = rows((1, 5)).join(index.read().hint("merge"), "text_digest", "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    index.drop()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_rolling_hash_is_a_polynomial(values, window):
    base = 0x9E3779B97F4A7C15
    got = rolling(np.array(values, np.uint64), window, np.uint64(base))
    want = [
        sum(v * base ** (window - 1 - j) for j, v in enumerate(values[s : s + window])) % 2**64
        for s in range(len(values) - window + 1)
    ]
    assert got.tolist() == want


def test_window_dedup(make_docs):
    rows = corpus(2)
    want = brute.later_windows(rows, 20)
    found = without_repeats(make_docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, brute.sha(r.kept_text.encode())) == want[r.doc_id], r.doc_id
        assert r.n_removed == sum(b - a for a, b in zip(r.begins or [], r.ends or [], strict=True))


def test_window_dedup_in_many_slices(make_docs, monkeypatch):
    rows = corpus(3)
    docs = make_docs(rows).repartition(7)
    want = brute.later_windows(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(docs).collect()} == {
        i: x[:2] for i, x in want.items()
    }


def test_repeats_where_doc_ids_are_null_or_shared(make_docs):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(None, passage, None, None), (1, passage, None, None), (1, "other " + passage, None, None)]
    removed = {(r.doc_id, r.n_words): r.n_removed for r in without_repeats(make_docs(rows)).collect()}
    assert removed == {(None, 25): 0, (1, 25): 25, (1, 26): 25}


@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_run_length_index_matches(strings):
    index = RunIndex(strings)
    suffixes = [(k, i, s[i:]) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i, tail in suffixes:
        best = 0
        for other in (t for a, b, t in suffixes if (a, b) != (k, i)):
            same = 0
            while same < min(len(tail), len(other)) and tail[same] == other[same]:
                same += 1
            best = max(best, same)
        assert index.matched[index.begins[k] + i] == best
    assert len(index.run_heads) <= len(index.text)


@pytest.mark.parametrize("crowded", [4_000_000, 500])
def test_long_repeats(make_docs, scratch, monkeypatch, crowded):
    monkeypatch.setattr(runindex, "CROWDED_BYTES", crowded)
    rows = corpus(4)
    want = brute.repeated_bytes(rows, 60)
    found = without_long_repeats(make_docs(rows), scratch, length=60, gram=20).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_long_text_in_parts(make_docs, monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8))
    owned = 0
    for (_, owner, starts, _), _ in runindex._pieces([text, b"short", text[:700]], 400):
        owned += len(starts)
        assert len(owner) == len(starts)
    assert owned == 4601 + 301


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(make_docs, scratch, monkeypatch, small):
    monkeypatch.setattr(chosenpath, "SMALL", max(small, 4))
    rows = corpus(5)
    base = " ".join(f"v{i}" for i in range(120)).split()
    for k in range(30):  # a group larger than a small node
        words = list(base)
        words[k * 3] = f"edit{k}"
        rows.append((1000 + k, " ".join(words), None, None))
    want = brute.near_components(rows)
    found = near_duplicates(make_docs(rows), scratch).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == want[r.doc_id][1])


def test_near_dedup_keeps_one_document_of_each_group(make_docs, scratch):
    rows = corpus(6)
    docs = make_docs(rows)
    kept = drop_near_duplicates(docs, scratch)
    assert kept.columns == docs.columns
    want = brute.near_components(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_components_of_a_long_chain(spark, scratch):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint"), scratch)
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty_tables(make_docs, scratch):
    docs = make_docs([])
    assert exact_duplicates(docs, scratch).isEmpty()
    assert drop_exact_duplicates(docs, scratch).isEmpty()
    assert without_repeats(docs).isEmpty()
    assert without_long_repeats(docs, scratch).isEmpty()
    assert near_duplicates(docs, scratch).isEmpty()
    assert drop_near_duplicates(docs, scratch).isEmpty()


@pytest.mark.parametrize("size", [50, 400, 600, 5000])
def test_briefs_tell_unrelated_sets_of_any_size_apart(size):
    rng = np.random.default_rng(6)
    agree = lambda x, y: (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()
    for _ in range(20):
        left, right = (rng.integers(0, 2**64, size, dtype=np.uint64) for _ in range(2))
        one, two = (chosenpath.brief(chosenpath.signature(x)) for x in (left, right))
        assert agree(one, two) < 0.2
        near = np.append(left[: size * 7 // 8], right[: size // 8])  # similarity at about the threshold
        assert agree(one, chosenpath.brief(chosenpath.signature(near))) >= chosenpath.ESTIMATE


def crowd(count=150, size=160):
    """Near copies of one text, about as many linked as not."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(count):
        words = [f"w{i}" for i in range(size)]
        for at in rng.choice(size, 1 + k % 7, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words), None, None))
    return rows


@pytest.mark.parametrize("small, half", [(4096, 1000), (4096, 40), (64, 1000)])
def test_a_crowd_of_near_copies_is_linked_in_full(make_docs, scratch, monkeypatch, small, half):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "HALF_MEMBERS", half)
    rows = crowd() + [(1000 + i, t, lang, source) for i, t, lang, source in corpus(7)]
    want = brute.near_components(rows)
    assert len({c for i, (_, c) in want.items() if i < 150}) > 30  # many link with none
    found = near_duplicates(make_docs(rows), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_the_pairs_of_a_crowd_are_no_rows(make_docs, scratch):
    rows = crowd()
    join = chosenpath.Join(chosenpath.with_digest(make_docs(rows).select("doc_id", "text")), scratch)
    lists = join.classes.agg(chosenpath.F.sort_array(chosenpath.F.collect_list("set_key")).alias("members"))
    assert join.small_pairs(lists).count() <= len(rows)


@pytest.mark.parametrize("few, step", [(12, 4096), (3, 7)])
def test_intersections_of_all_sets_at_once(few, step):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 900, n)).astype(np.uint64) for n in rng.integers(0, 120, 40)]
    both = chosenpath.in_common(sets, few, step)
    for i in range(40):
        for j in range(i + 1, 40):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize("half_members, half_bytes", [(3, 4_000_000), (1000, 50), (1000, 1)])
def test_parts_of_a_crowd_bring_any_two_together(monkeypatch, half_members, half_bytes):
    monkeypatch.setattr(chosenpath, "HALF_MEMBERS", half_members)
    monkeypatch.setattr(chosenpath, "HALF_BYTES", half_bytes)
    found = chosenpath.parts(list(range(10, 0, -1)), [3] * 10)
    assert all(any({i, j} <= set(p) for p in found) for i in range(1, 11) for j in range(1, 11))
    assert all(p == sorted(p) and len(p) <= 2 * min(half_members, max(1, half_bytes // 18)) for p in found)
