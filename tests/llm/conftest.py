from __future__ import annotations

import random

import pytest

CLASHING = ("text_key", "row", "label", "n_words", "kept", "size", "path", "text_digest", "member", "begin", "pass")


def corpus(seed: int = 1, count: int = 60) -> list[tuple]:
    """Rows (doc_id, text, lang, source): copies, near copies, shared passages, nulls, empties, repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ,.")[0] for _ in range(rng.randint(1, 7))).replace(" ", "x")
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    texts = [text(rng.randint(1, 200)) for _ in range(count)]
    texts += [texts[3], texts[3].upper(), texts[4], texts[5] + "\n" + texts[5]]
    for i in (6, 7, 8):
        words = texts[i].split()
        if len(words) > 20:
            words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [text(30) + " " + passage + " " + text(20), passage, text(5) + "\t" + passage]
    texts += [None, "", " \n\t ", "one", "one", "Two words", "a " * 500, "x" * 3000, text(6000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß3", None])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0]]  # one row twice


@pytest.fixture
def make_docs(spark):
    """A documents table with further columns whose names operators use inside."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        schema += "".join(f", {c} string" for c in CLASHING)
        full = [(i, t, lang, source, len(t or ""), *["?"] * len(CLASHING)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def scratch(spark):
    from tillgrain.session import Scratch

    with Scratch(spark) as held:
        yield held
