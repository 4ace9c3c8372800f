from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.conftest import corpus
from tillgrain.llm.lexical import Leaders, answer, ranked_search
from tillgrain.llm.quantised import bounded, merge, near_vectors, quantise, scaled, slack
from tillgrain.llm.spelling import CountTrie, group_counts, one_edit, spelling_variants, word_counts
import tillgrain.llm.spelling as spelling

# vectors


def plain_links(rows, threshold=0.93):
    """(n_links, component_id) per row by comparing all pairs."""

    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    counts = [0] * len(rows)
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if label is None or label != other or not fine(v) or not fine(w) or len(v) != len(w):
                continue
            a, b = np.array(v, float) / max(map(abs, v)), np.array(w, float) / max(map(abs, w))
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                counts[i] += 1
                counts[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(least.get(root(i), vec_id), vec_id)
    return [(vec_id, counts[i], least.get(root(i))) for i, (vec_id, *_) in enumerate(rows)]


def vectors(kind):
    rng = np.random.default_rng(3)
    cast = (lambda v: [float(np.float32(x)) for x in v]) if kind == "float" else (lambda v: [float(x) for x in v])
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 9))
        for c in centres:
            rows += [(len(rows) + k, cast(c * rng.uniform(0.1, 9) + rng.normal(size=9) * s), label) for k, s in enumerate((0, 0.1, 0.2, 0.3, 0.5))]
    same = cast(rng.normal(size=9))
    rows += [(1000 + i, same, 1) for i in range(40)] + [(7, same, 1), (7, same, 1), (None, same, 1)]
    rows += [(2000, [0.0] * 9, 1), (2001, None, 1), (2002, [], 1), (2003, [*same[:8], None], 1), (2004, [*same[:8], float("nan")], 1)]
    rows += [(2005, [*same[:8], float("inf")], 1), (2006, same[:5], 1), (2007, [x * 1e18 for x in same], 1), (2008, [x * 1e-30 for x in same], 1)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile_rows", [7, 8192])
def test_near_vectors(spark, scratch, kind, tile_rows):
    rows = vectors(kind)
    schema = f"vec_id bigint, embedding array<{kind}>, label int, class string, block string, copies string"
    frame = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], schema)
    found = near_vectors(frame, scratch, tile_rows=tile_rows).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=key) == sorted(plain_links(rows), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_no_vectors(spark, scratch):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_vectors(empty, scratch).collect() == []


@given(st.integers(0, 10**6), st.integers(1, 80), st.floats(0.001, 1.0))
@settings(max_examples=80, deadline=None)
def test_coded_products_bound_cosines(seed, dims, spread):
    rng = np.random.default_rng(seed)
    x = scaled(rng.normal(size=(1, dims)) + spread * rng.normal(size=(12, dims)) * rng.choice([1e-6, 1, 1e6], size=(12, 1)) + 1e-9)
    left, right = bounded(*quantise(x))
    norms = np.linalg.norm(x, axis=1)
    cosines = x @ x.T / np.outer(norms, norms)
    upper = (left @ right.T).astype(np.float64) + slack(dims)
    assert (upper >= cosines - 1e-12).all()
    assert (upper - cosines).max() < 0.02 + 0.01 * math.sqrt(dims)


@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_merge_finds_smallest_members(count, edges):
    edges = [(a % count, b % count) for a, b in edges]
    roots = merge(np.arange(count), *np.array(edges or [(0, 0)], np.int64).T)
    groups = [{i} for i in range(count)]
    for a, b in edges:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for i in groups[a]:
                groups[i] = groups[a]
    assert roots.tolist() == [min(g) for g in groups]


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


def plain_search(docs, items, best):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    lengths = [sum(bag.values()) for _, bag in bags]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item_id, text in set(items):
        scores = []
        for (doc_id, bag), n in zip(bags, lengths, strict=True):
            score = 0
            for t in set(terms(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * bag[t] // (1000 * bag[t] + 20 * (100 - 50 + 50 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if bare else i, -s) for k, (s, bare, i) in enumerate(sorted(scores)[:best])]
    return out


@pytest.mark.parametrize("best, most_terms", [(3, 10), (50, 200_000)])
def test_ranked_search(spark, make_docs, scratch, best, most_terms, monkeypatch):
    rows = [*corpus(5), (None, "one two words", None, None), (500, "Straße STRASSE straße-99", None, None)]
    texts = [t for _, t, *_ in rows if t]
    long = " ".join(texts[3:9])
    items = [(1, texts[0][:200]), (2, None), (3, ""), (4, "?!, ."), (5, "one, ONE two straße"), (5, "words"), (5, "words"), (None, "one"), (6, long), (7, "notthere")]
    frame = spark.createDataFrame([(*i, "?", 1) for i in items], "item_id bigint, text string, item string, rank int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = ranked_search(make_docs(rows).repartition(3), frame, scratch, best, most_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_search(rows, items, best), key=key)


def test_search_of_nothing(spark, make_docs, scratch):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert ranked_search(make_docs([(1, None, None, None)]), items, scratch).collect() == []
    assert ranked_search(make_docs([(1, "one", None, None)]), items.limit(0), scratch).collect() == []
    assert ranked_search(make_docs([(1, "one", None, None)]).limit(0), items, scratch).collect() == []


@given(st.integers(0, 10**6), st.integers(1, 130), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_masks_lose_no_leader_and_skip_the_rest(seed, n_terms, best):
    rng = np.random.default_rng(seed)
    ids, bare = np.arange(300), np.zeros(300, bool)
    postings = []
    for _ in range(n_terms):
        docs = np.flatnonzero(rng.random(300) < rng.random() * 0.2)
        if len(docs):
            postings.append((docs, rng.integers(1, 50, len(docs))))
    sums = np.zeros(300, np.int64)
    for docs, gains in postings:
        sums[docs] += gains
    want = sorted((-s, i) for i, s in enumerate(sums) if s)[:best]
    held = Leaders(best)
    if postings:
        scored = answer(postings, ids, bare, held)
        assert [(-s, i) for s, i in zip(held.scores, held.ids, strict=True)] == want
        assert scored <= (sums > 0).sum()


def test_bounds_end_the_search_early():
    docs = np.arange(1000)
    postings = [(docs[:10], np.full(10, 900)), (docs, np.ones(1000, np.int64))]
    held = Leaders(5)
    assert answer(postings, docs, np.zeros(1000, bool), held) == 10
    assert held.ids.tolist() == [0, 1, 2, 3, 4]


# spelling


def plain_words(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    form, out = {}, {}
    near = {w: [x for x in words if apart_by_one(w, x)] for w in words}
    for w, others in near.items():
        first = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = first if first is not None and words[first] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def vocabulary(seed, count):
    rng = random.Random(seed)
    words = {}
    for _ in range(count):
        word = "".join(rng.choice("abcéÿz") for _ in range(rng.randint(7, 9)))
        for _ in range(rng.randint(1, 4)):
            words[word] = rng.choice([2, 2, 3, 25, 30, 400, 5000])
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "a", "éc", "zz"]) + word[at + rng.randint(0, 1) :]
            if len(word) < 7:
                break
    words["abcabcabc" * 300], words["abcabcabc" * 300 + "a"] = 9, 900
    return words


@pytest.mark.parametrize("most_letters", [60, 2000, spelling.MOST_LETTERS])
def test_spelling_variants(spark, scratch, most_letters):
    words = vocabulary(4, 150)
    if most_letters == 60:  # words of equal counts, dealt by halves
        words = {w: n for w, n in list(words.items())[:40]}
        words |= {w: 2 + len(w) for w in ("aabbccc", "aabcbcc", "abaccbc", "aabbcca", "aabbccac", "aaabbccc", "caabbcc", "aabbccb")}
    frame = spark.createDataFrame([(w, n, "?", "?") for w, n in words.items()], "word string, n bigint, cell string, near string")
    found = spelling_variants(frame, scratch, most_letters)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r)[1:] for r in found.collect()} == plain_variants(words)


def test_words_of_documents(make_docs, scratch):
    rng = random.Random(2)
    words = [w.upper() if i % 3 else w for i, w in enumerate(vocabulary(6, 30))]
    rows = [(i, " ".join(rng.choices(words, k=60)) + rng.choice(["×÷ÀÿÆæþ", ".kelvinKkelvin", "İstanbul"]), None, None) for i in range(40)]
    rows += [(None, "Wörterbuch wörterbuch", None, None), (3, None, None, None), (4, "", None, None), rows[0]]
    counted = word_counts(make_docs(rows))
    assert {r.word: r.n for r in counted.collect()} == plain_words(rows)
    found = spelling_variants(counted, scratch)
    assert {r.word: tuple(r)[1:] for r in found.collect()} == plain_variants(plain_words(rows))


def test_no_words(spark, make_docs, scratch):
    assert spelling_variants(word_counts(make_docs([(1, "short words", None, None)])), scratch).collect() == []
    assert spelling_variants(word_counts(make_docs([(1, None, None, None)]).limit(0)), scratch).collect() == []


@given(st.lists(st.text("abqé", min_size=1, max_size=6), min_size=2, max_size=30, unique=True), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_trie_reaches_all_words_one_edit_apart(words, batch):
    codes, sizes = spelling._codes(words)
    trie = CountTrie(group_counts(codes))
    reached = set()
    for probe, leaf in trie.reach(group_counts(codes), batch):
        for p, x in zip(probe, leaf, strict=True):
            reached |= {(words[p], words[i]) for i in trie.order[trie.begins[x] : trie.begins[x + 1]]}
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words))]
    a, b = np.array(pairs).T
    near = one_edit(codes[a], codes[b], sizes[a], sizes[b])
    for (i, j), got in zip(pairs, near, strict=True):
        assert got == apart_by_one(words[i], words[j])
        assert not got or (words[i], words[j]) in reached
