from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import corpus
from tillgrain.llm import registry
from tillgrain.llm.bytebpe import RANKS, encoding


def test_stages_keep_columns_and_whole_texts(spark, make_docs, scratch, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 90))), "en", f"s{i % 4}") for i in range(80)]
    rows += [(i, rows[i][1].upper(), "en", "s9") for i in range(5)]
    rows += [r for r in corpus(13, 10)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, given = docs.columns, {t for _, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names
        assert {r.text for r in docs.collect()} <= given, name
    texts = [r.text for r in docs.collect()]
    normal = {t.translate(brute.LOWER) for t in texts}
    assert len(normal) == len(set(texts))
    sets = brute.near_components([(i, t) for i, t in enumerate(sorted(set(texts)))])
    assert all(i == c for i, (_, c) in sets.items())
    encoder = encoding(RANKS, corpus_pipeline.tokens.__globals__["public_tokenizers"].PATTERN)
    result = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in result) == sorted(len(encoder.encode_ordinary(t)) for t in texts)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.decoded_sha256 for r in whole) == sorted(r.decoded_sha256 for r in result)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert registry.ORACLES.keys() <= registry.QUERIES.keys()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    from tests.compare import check, connect

    folder = "/root/testdata/sf0.001"
    assert check(spark, folder, connect(folder), registry.QUERIES[name], registry.ORACLES[name]) == []
