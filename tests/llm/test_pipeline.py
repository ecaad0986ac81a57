import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from idlattice.llm import bpe

from ..conftest import TINY
from . import test_decontamination, test_quality_rules, test_simhash, test_substring_dedup


def test_run_equals_brute_force(spark):
    """Each stage in plain Python; the verdicts of the first are those that its own test proves."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    from idlattice.llm import quality_rules

    kept = {r.doc_id for r in quality_rules.op4_quality_rules(spark, TINY).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    assert all(not test_quality_rules.base(t)[5] for _, t in rows)
    group = test_simhash.plain_groups([(k, test_simhash.plain_fingerprint(t)) for k, t in rows])
    rows = [(k, t) for k, t in rows if group[k] == k]
    cut = test_substring_dedup.brute(rows)
    rows = [(k, cut[k][0]) for k, _ in rows]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    leaks = {r[0] for r in test_decontamination.brute(rows, items) if r[5]}
    rows = [(k, t) for k, t in rows if k not in leaks]
    library = Tokenizer.from_file(bpe.vocabulary())
    want = set()
    for k, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, TINY).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
