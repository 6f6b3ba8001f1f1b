"""The pipeline, stage by stage and whole, against direct computations."""
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
from llm_data import frame
from rewardlake.llm import langid, pii, quality, simhash
from test_llm_simhash import brute_groups, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "SimHash near-dedup", "PII", "best-fit packing"]
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert E.oracle_sql().get("op1_exact_topk")


def test_run_equals_steps_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    scorer = quality.fit(docs)
    rows = [r for r in docs.collect() if scorer.score(r.text) >= quality.REJECT_BELOW]
    kept = spark.createDataFrame(rows, docs.schema)
    ok = {r.doc_id: r.lang for r in langid.identify(
        langid.document_evidence(kept), "doc_id",
        langid.Fusion(langid.document_evidence(kept))).collect() if r.accepted}
    rows = [r for r in rows if r.doc_id in ok]
    group = brute_groups([slow_fingerprint(r.text) for r in rows])
    first = {}
    for r, g in zip(rows, group):
        if g not in first or r.doc_id < first[g].doc_id:
            first[g] = r
    left = spark.createDataFrame(list(first.values()), docs.schema)
    masked = {r.doc_id: r.text for r in pii.redact(left).collect()}
    for d, t in masked.items():
        assert not any(pii.base_spans(t).values()), d
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in masked.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            want.add((d, p, s, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)


def test_stages_take_odd_documents(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_dedup_stage_keeps_the_smallest_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    group = brute_groups([slow_fingerprint(r.text) for r in rows])
    want = {min(r.doc_id for r, h in zip(rows, group) if h == g) for g in set(group)}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == want


def test_sequences_come_out_with_their_ids(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got
    for r in got:
        assert len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
