"""The pipeline's stages against brute force on what each stage got."""

import collections
import re

import __spark_entry__ as entry
import corpus_pipeline
from cellweave.llm.common import cut, table
from cellweave.llm.toxicity import toxicity
from test_llm import brute_components, rows_of

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], D), name))
    for kept in steps[1:-1]:
        assert kept.columns == columns
    given, clean, single, distinct, mixed, packed = steps
    bad = {r.doc_id for r in toxicity(given, table(spark, D, "labels")).filter("predicted = 1").collect()}
    assert {i for i, _ in rows_of(clean)} == {i for i, _ in rows_of(given)} - bad
    first = {}
    for i, t in sorted(rows_of(clean)):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), i)
    assert sorted(i for i, _ in rows_of(single)) == sorted(first.values())
    _, label = brute_components(rows_of(single))
    assert sorted(i for i, _ in rows_of(distinct)) == sorted(set(label.values()))
    uses = collections.Counter(i for i, _ in rows_of(mixed))
    assert set(uses) <= {i for i, _ in rows_of(distinct)} and max(uses.values()) <= 3
    assert collections.Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == uses


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 13
