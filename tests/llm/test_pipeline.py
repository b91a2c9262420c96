"""The corpus pipeline, stage by stage, against plain single-process versions."""

import hashlib
import os
import re
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from .test_dedup import plain_classes, plain_lines

from tapeframe.llm import bpe, decontaminate, quality

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and every stage's result, each written and read again."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(base / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return " ".join("".join(c if not c.isascii() or c.isalnum() else " " for c in text.lower()).split())


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality(spark, stages):
    want = {r.doc_id for r in quality.score(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.3").collect()}
    assert set(rows(stages[1])) == want < set(rows(stages[0]))


def test_lines(stages):
    before = sorted((d, r.text) for d, r in rows(stages[1]).items())
    want = {d: t for d, t in plain_lines(before, 50).items() if t.strip()}
    assert {d: r.text for d, r in rows(stages[2]).items()} == want


def test_groups(stages):
    before = [(d, r.text) for d, r in rows(stages[2]).items()]
    assert set(rows(stages[3])) == {d for d, (c, _) in plain_classes(before).items() if c == d}


def test_benchmark(spark, stages):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = set(rows(stages[4]))
    for d, r in rows(stages[3]).items():
        text = words(r.text)
        if d in kept:
            assert not any(i in text for i in items)
        else:
            assert any(decontaminate.distance_within(i, text, int(0.2 * len(i))) is not None for i in items)


def test_encoding_and_whole_run(spark, stages):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = {}
    for d, r in rows(stages[4]).items():
        ids = other.encode_ordinary(r.text)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    shown = lambda df: {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}
    assert shown(stages[5]) == want
    assert shown(corpus_pipeline.run(spark, SF)) == want


def test_odd_rows(spark, odd):
    """Every stage takes nulls, empty and very long texts and repeated rows."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
