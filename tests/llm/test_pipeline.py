"""The pipeline's stages over a small table, each against a plain definition on its own input; all queries run."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from tactus.llm import toxicity
from tactus.llm.catalog import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into every stage, and what came out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 100_000))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", "en", None, 5), (7_000_000, None, None, "src1", None), (7_000_001, "", "en", "src1", 0)], docs.schema))
    held = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, held[-1], SF).write.parquet(path)
        held.append(spark.read.parquet(path))
    return held


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "chunk_bpe"]
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.toxicity(stages[0], model)
    stay = Counter(r["doc_id"] for r in scores.where("predicted = 0").collect())
    assert Counter(i for i, _ in texts(stages[1])) == stay and len(stay) < stages[0].count()


def test_repeated_lines_go(stages):
    kept = brute.kept_lines(texts(stages[1]))
    found = dict(x for x in texts(stages[2]) if x[0] is not None)
    for i, text in texts(stages[1]):
        lines = (text or "").split("\n")
        inked = [n for n, line in enumerate(lines) if brute.SPACE_WORDS.search(line)]
        if i is None or not inked:
            assert i is None or found[i] == text
        elif kept[i]:
            assert found[i] == "\n".join(line for n, line in enumerate(lines) if n in kept[i] or n not in inked)
        else:
            assert i not in found


def test_one_of_each_group(stages):
    sets = {i: brute.shingles(t, 5) for i, t in texts(stages[2]) if i is not None}
    union = brute.Union(sets)
    for a, b in brute.similar(sets, 80):
        union.join(a, b)
    assert {i for i, _ in texts(stages[3])} == {None, *(i for i in sets if union.top(i) == i)}


def test_mixing_repeats_whole_documents(stages):
    before, after = Counter(texts(stages[3])), Counter(texts(stages[4]))
    assert before.keys() == after.keys() and all(after[x] >= n for x, n in before.items())


def test_ids_and_texts(stages):
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    expected = Counter()
    for i, text in texts(stages[4]):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in stages[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == expected


def test_registered_names():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in QUERIES}
    assert QUERIES.keys() <= entry_point.queries().keys() and ORACLES.keys() <= entry_point.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    """As many rows as the SQL gives, or one for each document; the pipeline drops and repeats some."""
    rows = QUERIES[name](spark, SF).count()
    if name in ORACLES:
        with duckdb.connect() as db:
            for table in ("documents", "embeddings", "benchmark"):
                db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
            assert rows == len(db.execute(ORACLES[name]).fetchall())
    else:
        assert rows >= (100 if name == "pipeline" else spark.read.parquet(f"{SF}/documents.parquet").count())
