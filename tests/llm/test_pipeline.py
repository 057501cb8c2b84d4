"""The pipeline against its stages done by brute force, and every query's columns."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import fixtures as fx  # noqa: E402

from viewloom.llm.queries import ORACLE, QUERIES  # noqa: E402


def test_pipeline_equals_brute_force(spark, data):
    import corpus_pipeline
    from viewloom.llm import quality
    from viewloom.llm.common import read

    rows = {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}
    good = {r["doc_id"] for r in quality.verdicts(read(spark, data, "documents")).where("kept").collect()}
    assert all(not fx.quality(rows[d])[5] for d in good)
    docs = {d: t for d, t in rows.items() if d in good}
    docs = {d: t for d, (t, n) in fx.deduped_lines(docs).items() if not n or fx.WORD.search(t)}
    docs = {d: docs[d] for d, (_, c) in fx.components(docs).items() if d == c}
    items = [tuple(r) for r in read(spark, data, "benchmark").select("item_id", "text").collect()]
    docs = {d: t for d, t in docs.items() if not fx.hits(t, items)[4]}
    from tokenizers import Tokenizer

    from viewloom.llm import packing

    t = Tokenizer.from_file(packing.vocabulary())
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, data).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in docs.items()}


COLUMNS = {
    "op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3": "page_id payload_bytes payload_digest record_type refers_to", "op7": "doc_id size text_crc32 law shard slot grown_shard",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans", "op9": "doc_id n_shingles component_id",
    "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, data, name):
    q = next(f for k, f in QUERIES.items() if k.startswith(f"{name}_"))
    assert q(spark, data).columns == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, name):
    from compare import connect, same

    same(QUERIES[name](spark, data), connect(data), ORACLE[name])
