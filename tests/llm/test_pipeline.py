from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tallyfold.llm import pii, quality_rules
from tests.llm import brute


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in quality_rules.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").collect()}
    docs = {i: t for i, t in docs.items() if i in kept}
    ids = sorted(docs)
    group = brute.components(ids, [brute.fingerprint(docs[i]) for i in ids])
    docs = {i: docs[i] for i in ids if group[i] == i}
    docs = {i: t for i, t in docs.items() if not brute.contamination(t, items)[1]}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert all(sum(brute.personal(t)[0]) == 0 for t in clean.values())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb")) if a}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(clean)
    for i, t in clean.items():
        raw = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert bytes(got[i]["ids"]) == raw and got[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest() and got[i]["decoded_sha256"] == brute.sha(t)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.filter("false"), sf_dir).isEmpty()
