"""Registered training-data queries: against their SQL, and the pipeline against its stages done by hand."""

import collections
import re

import pytest

import corpus_pipeline
from tests.conftest import compare
from tests.llm.test_tokens import expected
from tracelens.llm import queries
from tracelens.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, data, name):
    n = queries.QUERIES[name](spark, data).count()
    whole, each = {"op9_url_filters": ("pages", 1), "op12_whitening": ("embeddings", 32)}.get(name, ("documents", 1))
    assert n == each * table(spark, data, whole).count() or name in ("op3_source_mixing", "op6_decontamination") and n > 0


def test_stage_decisions_take_effect(spark, data):
    docs = table(spark, data, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        path = f"/tmp/stage-{name.replace(' ', '-')}-{id(after)}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    whole = table(spark, data, "documents").collect()
    report = {r.doc_id for r in queries.QUERIES["op2_quality_rules"](spark, data).where("kept").collect()}
    assert {r.doc_id for r in kept[0]} == report and len(report) < len(whole)
    texts = [r.text for r in kept[1]]
    assert len(texts) == len(set(texts)) and len(kept[1]) < len(kept[0])
    normal = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    items = [normal(r.text) for r in table(spark, data, "benchmark").collect()]
    leaked = {r.doc_id for r in kept[1] if any(i in normal(r.text) for i in items)}
    assert not leaked & {r.doc_id for r in kept[2]}
    copies = collections.Counter(r.doc_id for r in kept[3])
    assert max(copies.values()) <= 2
    final = corpus_pipeline.run(spark, data).orderBy("start").collect()
    assert [tuple(r) for r in final] == expected([(r.doc_id, r.text) for r in kept[3]])
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in kept[3])
    assert [r.start for r in final] == [sum(x.n_tokens for x in final[:k]) for k in range(len(final))]
