"""The pipeline against the same stages by brute force, and the registered names."""

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import SP, brute_budgets, brute_similar, docs_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemill.llm import piece_codec, quality_rules, secret_scan, source_mix  # noqa: E402


def test_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_by_brute_force(spark, data):
    import sentencepiece

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in kept), key=lambda r: r.doc_id)
    roots = brute_similar([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    scanner = secret_scan.Scanner()
    clean = {r.doc_id: secret_scan.redacted(r.text, scanner.scan([r.text])[0]) for r in rows}
    mix, leaves, members = corpus_pipeline.MIX, defaultdict(int), defaultdict(list)
    domain = {r.doc_id: r.domain for r in docs.withColumn("domain", source_mix.domain_of()).collect()}
    for r in rows:
        leaf, n = (domain[r.doc_id], r.lang, r.source), len(SP.findall(clean[r.doc_id]))
        leaves[leaf] += n
        members[leaf].append((r.doc_id, n))
    budget = brute_budgets(dict(leaves), mix)
    taken = set()
    for leaf, own in members.items():
        epochs, need = divmod(budget[leaf], leaves[leaf])
        seen = 0
        for i, n in sorted(own, key=lambda m: hashlib.md5(f"{mix.seed}:{epochs}:{m[0]}".encode()).hexdigest()):
            if epochs or seen < need:
                taken.add(i)
            seen += n
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == taken
    for i, r in got.items():
        assert r.round_trip and r.ids == lib.encode(clean[i]) and r.n_tokens == len(r.ids)


def test_stages_keep_columns_and_take_odd_rows(spark, data):
    texts = [None, "", "word " * 80, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(300)) + " token=abcdefgh1234", " ".join(f"u{i}" for i in range(90))]
    docs = docs_of(spark, texts, langs=["en", None, "en", "de", "de", "fr", None], sources=["src0", None, "src1", "src2", "src2", "src3", "odd"])
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, data)
            assert now.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, now, data)
        assert "doc_id" in out.columns
        out.collect()


def test_near_duplicates_by_similarity(spark, data):
    """Edited copies that differ in more than three bits of a fingerprint go, too."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    roots = brute_similar([r.text for r in rows])
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()}
    assert got == {r.doc_id for i, r in enumerate(rows) if roots[i] == i}


def test_workers_get_batches_of_bounded_bytes(spark, data):
    """Executors hold a batch outside the heap and again in the worker: long rows come in more batches."""
    import pyarrow as pa

    from tidemill.llm import _common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    was = spark.conf.get(_common._BATCH, None)
    spark.conf.unset(_common._BATCH)
    try:
        docs = docs_of(spark, [f"{i} " + "word " * 2000 for i in range(1500)]).coalesce(1)
        corpus_pipeline.quality(spark, docs, data)
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 1500
        assert max(r.size for r in found) <= 1.1 * _common.BLOCK_BYTES
    finally:
        spark.conf.unset(_common._BATCH) if was is None else spark.conf.set(_common._BATCH, was)


def test_encoder_keeps_few_words(monkeypatch):
    """What a worker keeps of earlier blocks is bounded, and encodings don't depend on it."""
    import sentencepiece

    m = piece_codec.PieceModel(piece_codec.vocabulary())
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.vocabulary())
    for at in range(12):
        texts = [f"alpha{at}x{i} beta{i % 50}" for i in range(5000)]
        ids = m.encode(texts, 30_000)
        assert [i.tolist() for i in ids[:20]] == [lib.encode(t) for t in texts[:20]]
    assert len(m.known) <= 40_000
