"""The pipeline, stage by stage, against brute force."""

from collections import Counter

from edge import documents, empty
from test_joins import contained, linked, shingles
from test_rows import check_shards

import corpus_pipeline
from vigilark.llm import queries
from vigilark.llm.common import DOCUMENT_COLUMNS, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    steps = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns[:5] == list(DOCUMENT_COLUMNS)
        steps.append(docs.collect())
    start, known, single, clean, mixed, shards = steps
    assert {r.doc_id for r in start} - {r.doc_id for r in known} <= {r.doc_id for r in start if not any(c.isalpha() for c in r.text or "")}
    component = linked({r.doc_id: shingles(r.text) for r in known})
    assert {r.doc_id for r in single} == set(component.values())
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in contained([(r.doc_id, r.text) for r in single], items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - bad
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in clean} and max(copies.values()) <= 2
    assert Counter(r.doc_id for r in shards) == copies
    check_shards(shards, 24)


def test_stages_on_odd_rows(spark):
    for source in (documents(spark), empty(spark)):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        docs.collect()
