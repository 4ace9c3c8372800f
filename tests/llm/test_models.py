from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from tests.llm import brute
from tests.llm.conftest import corpus
from tillgrain.llm import crf, perplexity
from tillgrain.llm.crf import BLOCK, Chains, identify
from tillgrain.llm.perplexity import grams, judged, letters, passing, store, train

STEMS = {"xx": ["kra", "tok", "mib", "zu"], "yy": ["eoa", "iel", "oua", "se"]}


def speech(lang, rng, count):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(count))


def test_base_counts(make_docs, scratch):
    rows = [*corpus(12), (4000, "a b\na b\n\n \n \na b # $é <>", "en", None)]
    found = {r.doc_id: r for r in judged(make_docs(rows), F.col("doc_id"), scratch).withColumn("doc_id", F.col("row")).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if brute.WORD.search(line):
                repeated += line in seen
                seen.add(line)
        windows = [tuple(words[s : s + 5]) for s in range(len(words) - 4)]
        counts = Counter(windows)
        again = len({j for s, w in enumerate(windows) if counts[w] > 1 for j in range(s, s + 5)})
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), repeated, again)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(words) < 10 or 100 * again > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_model_is_kneser_ney(make_docs, scratch):
    rng = random.Random(1)
    texts = [speech("xx", rng, 30) for _ in range(20)]
    rows = [(i, t, "xx", None) for i, t in enumerate(texts)]
    model = train(make_docs(rows).select("lang", "text"), scratch).filter("lang = 'xx'")
    held = {r.key: r for r in model.collect()}
    counts = Counter(int(g) for t in texts for g in grams(letters(t)))
    order, bits = perplexity.ORDER, perplexity.BITS
    for g, n in counts.items():
        assert held[order << 60 | g].raw == n
    # probabilities after a context sum to one: seen codes, and the rest by back-off
    codes = {g & (1 << bits) - 1 for g in counts}

    def probability(context, code, k):
        if k == 0:
            return 1 / (len(codes) + 1)
        gram = (context & (1 << bits * (k - 1)) - 1) << bits | code
        entry = held.get(k << 60 | gram)
        if entry is not None and entry.raw:
            return math.exp(entry.logp)
        back = held.get((k - 1) << 60 | context & (1 << bits * (k - 1)) - 1)
        return (math.exp(back.bow) if back is not None and back.follow else 1.0) * probability(context, code, k - 1)

    for g in list(counts)[::37]:
        total = sum(probability(g >> bits, c, order) for c in codes)
        assert 0.97 < total <= 1 + 1e-6  # what is missing is left for unseen codes
    folder, files = store(model, scratch)
    codes = letters(texts[0])
    got = perplexity.log_probabilities(codes, "xx", files)
    assert len(got) == len(codes) and (got < 0).all() and got.mean() > -math.log(30)
    perplexity._load.cache_clear()


def plain_log_probabilities(text, model_of):
    """Kneser-Ney by dictionaries: what the text alone has counts as unseen."""
    order, bits = perplexity.ORDER, perplexity.BITS
    codes = letters(text).tolist()
    own, mine = Counter(), Counter()
    padded = [0] * (order - 1) + codes
    for i in range(len(codes)):
        for k in range(1, order + 1):
            gram = 0
            for c in padded[i + order - k : i + order]:
                gram = gram << bits | c
            own[k, gram] += 1
            mine[k - 1, gram >> bits] += 1
    out = []
    for i in range(len(codes)):
        value = 0.0
        for k in range(order, 0, -1):
            gram = 0
            for c in padded[i + order - k : i + order]:
                gram = gram << bits | c
            entry = model_of.get(k << 60 | gram)
            if entry is not None and entry.raw > own[k, gram]:
                value += entry.logp
                break
            context = model_of.get((k - 1) << 60 | gram >> bits)
            if context is not None and context.follow > mine[k - 1, gram >> bits]:
                value += context.bow
        else:
            value -= math.log(1 << bits)
        out.append(value)
    return out


def test_scores_of_a_slice_equal_plain_kneser_ney(make_docs, scratch, monkeypatch):
    rng = random.Random(9)
    texts = [speech("xx", rng, rng.randint(1, 60)) for _ in range(25)]
    texts += [texts[0] + " " + texts[1], texts[2] * 3, "Ünïcode \u4e2d\u6587 ΑΣ  \n\t x7 0", "", "zzzzzzzzzz", "qqqq zzzz"]
    docs = make_docs([(i, t, "xx", None) for i, t in enumerate(texts)]).select("lang", "text")
    held = {r.key: r for r in train(docs, scratch).filter("lang = 'xx'").collect()}
    monkeypatch.setattr(perplexity, "FILE_ROWS", 300)
    for least in (1, 2):  # what occurs once never matters
        _, files = store(perplexity.trained(docs, scratch, least)[0], scratch)
        assert len({path for *_, path in files}) > 3
        whole, text = perplexity.all_grams(*perplexity.all_letters([t.encode() for t in texts]))
        got = perplexity.all_log_probabilities(whole, text, "xx", files)
        want = [plain_log_probabilities(t, held) for t in texts]
        for i, logs in enumerate(want):
            assert np.allclose(got[text == i], logs, atol=1e-5), (least, i)
        perplexity._load.cache_clear()


def test_queries_score_is_the_plain_one(make_docs, scratch):
    rng = random.Random(10)
    texts = [(speech(lang or "yy", rng, rng.randint(12, 60)), lang) for lang in ["xx", "yy", None] * 12]
    docs = make_docs([(i, t, lang, None) for i, (t, lang) in enumerate(texts)])
    found = {r.row: r.perplexity for r in judged(docs, F.col("doc_id"), scratch).collect()}
    for lang in ("xx", "yy", None):
        alone = docs.filter(F.col("lang").eqNullSafe(F.lit(lang))).select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
        held = {r.key: r for r in train(alone, scratch).filter(F.col("lang") == (lang or "")).collect()}
        for i, (text, own) in enumerate(texts):
            if own == lang:
                logs = plain_log_probabilities(text, held)
                assert found[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-5)


def test_odd_documents_go_and_clean_ones_stay(make_docs, scratch):
    rng = random.Random(2)
    rows = [(i, speech("xx" if i % 2 else "yy", rng, rng.randint(12, 80)), "xx" if i % 2 else "yy", None) for i in range(200)]
    mixed = (500, speech("xx", rng, 40) + " " + speech("yy", rng, 40), "xx", None)
    noise = (501, " ".join("".join(chr(rng.randint(33, 900)) for _ in range(8)) for _ in range(40)), "yy", None)
    kept = {r.doc_id for r in passing(make_docs([*rows, mixed, noise, (502, None, None, None)]), scratch).collect()}
    clean = {i for i, *_ in rows if not brute_failed(dict((r[0], r[1]) for r in rows)[i])}
    assert clean <= kept and 500 in kept and not kept & {501, 502}


@pytest.mark.parametrize("share", [1 / 3, 0.8])
def test_copies_of_a_clean_text_do_not_explain_each_other(make_docs, scratch, share):
    rng = random.Random(4)
    texts = [(speech(lang, rng, rng.randint(40, 80)), lang) for lang in ["xx", "yy"] * 100]
    clean = speech("xx", rng, 200)
    alone = [*texts, (clean, "xx")]
    others = len(texts) if share < 0.5 else len(texts) // 2  # of all rows, or of its language
    copies = round(share / (1 - share) * others)
    crowd = [*texts, *[(clean, "xx")] * copies]
    noise = " ".join("".join(chr(rng.randint(33, 900)) for _ in range(8)) for _ in range(40))
    tables = []
    for rows in (alone, crowd, [*crowd, *[(noise, lang) for lang in ["yy", "xx", "zz"] * 40]]):
        docs = make_docs([(i, t, lang, None) for i, (t, lang) in enumerate(rows)])
        found = judged(docs, F.col("doc_id"), scratch).collect()
        assert len(found) == len(rows)
        tables.append({(rows[r.row], r.base_failed, r.kept, r.perplexity, r.lower_band, r.upper_band) for r in found})
    assert {x[2] for x in tables[0]} == {True}
    assert {(x[0], x[2]) for x in tables[1]} == {(x[0], x[2]) for x in tables[0]}
    for x, y in zip(sorted(tables[0]), sorted(tables[1]), strict=True):
        assert x[3:] == pytest.approx(y[3:], rel=1e-6)
    assert {x[2] for x in tables[2] if x[0] in {(noise, "xx"), (noise, "yy")}} == {False}


def brute_failed(text):
    words = text.split()
    windows = [tuple(words[s : s + 5]) for s in range(len(words) - 4)]
    counts = Counter(windows)
    again = len({j for s, w in enumerate(windows) if counts[w] > 1 for j in range(s, s + 5)})
    return len(words) < 10 or 100 * again > 20 * len(words)


def test_empty_tables(make_docs, scratch):
    docs = make_docs([])
    assert passing(docs, scratch).isEmpty()
    assert identify(docs, F.lit(True), F.lit(False), scratch).isEmpty()


@pytest.mark.parametrize("sizes", [[1, 2, 3], [BLOCK, 0, 3 * BLOCK + 5, 1], [0], [2 * BLOCK]])
def test_forward_backward(sizes):
    rng = np.random.default_rng(4)
    n = 3
    scores = rng.normal(size=(sum(sizes), n)).astype(np.float32)
    moves = rng.normal(size=(n, n)).astype(np.float32)
    got, pairs = Chains(np.array(sizes)).posteriors(scores, moves, pairs=True)
    at, expected = 0, np.zeros((n, n))
    for size in sizes:
        part = scores[at : at + size].astype(float)
        ahead = np.zeros((size, n))
        behind = np.zeros((size, n))
        for t in range(size):
            ahead[t] = part[t] + (np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0) if t else 0)
        for t in reversed(range(size - 1)):
            behind[t] = np.logaddexp.reduce(moves + part[t + 1] + behind[t + 1], axis=1)
        both = ahead + behind
        want = np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True)) if size else both
        assert np.allclose(got[at : at + size], want, atol=1e-4)
        for t in range(size - 1):
            joint = ahead[t][:, None] + moves + part[t + 1] + behind[t + 1]
            expected += np.exp(joint - np.logaddexp.reduce(joint, axis=None))
        at += size
    assert np.allclose(pairs, expected, atol=1e-3)


def test_languages_are_told_apart(make_docs, scratch):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = rng.choice(["xx", "yy"])
        rows.append((i, speech(lang, rng, rng.randint(1, 60)), lang if i % 5 else None, None))
    truth = {i: "xx" if re.search("k|b|z", t) else "yy" for i, t, *_ in rows}
    odd = [(900, None, "xx", None), (901, "", "yy", None), (902, "12 345 ...", "xx", None), (903, rows[0][1], "yy", "s")]
    found = identify(make_docs([*rows, *odd, rows[5]]), F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1, scratch).collect()
    assert len(found) == 245
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    right = sum(got[i].lang_pred == truth[i] for i in truth)
    assert right >= 0.97 * len(truth)
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id % 3 == 1) for r in found)


def test_code_switching_is_followed_word_by_word(make_docs, scratch):
    rng = random.Random(5)
    rows = [(i, speech(lang, rng, 40), lang, None) for i, lang in enumerate(["xx", "yy"] * 60)]
    model = crf.train(make_docs(rows).select(F.col("lang").alias("label"), "text"), scratch)
    text = f"{speech('xx', rng, 20)} {speech('yy', rng, 20)}".encode()
    words = crf.Words([text])
    marginals = Chains(words.counts).posteriors(words.scores(model), model.moves)
    assert model.moves[0, 0] + model.moves[1, 1] > model.moves[0, 1] + model.moves[1, 0]
    assert (marginals.argmax(axis=1) == np.repeat([0, 1], 20)).mean() > 0.9


def test_without_labels_all_is_undetermined(make_docs, scratch):
    found = identify(make_docs([(1, "some words", None, None)]), F.lit(True), F.lit(False), scratch).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
