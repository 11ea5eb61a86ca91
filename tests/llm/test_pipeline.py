"""The pipeline, each stage on its own input."""

import collections

import corpus_pipeline
from test_operators import awkward, empty, same_columns, sha  # noqa: F401
from test_shingles import plain_groups

from tracemesh.llm import mixing, subword
from tracemesh.llm.common import load
from tracemesh.session import materialise


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = subword.fit_quality(docs, load(spark, sf_dir, "labels"))
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    rows = [t.collect() for t in tables]
    for table in tables[1:-1]:
        assert table.columns == docs.columns
    whole = [collections.Counter(map(tuple, r)) for r in rows[:-1]]
    assert whole[1] <= whole[0] and whole[2] <= whole[1] and whole[3] <= whole[2]

    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if model.score(r.text) >= 0.5}
    last = {r.text: r.doc_id for r in sorted(rows[1])}
    assert {r.doc_id for r in rows[2]} == set(last.values())
    group = plain_groups([(r.doc_id, r.text) for r in rows[2]])
    assert {r.doc_id for r in rows[3]} == {i for i, c in group.items() if i == c} != set(group)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(tables[3]).collect()}
    assert collections.Counter(r.doc_id for r in rows[4]) == +collections.Counter(copies)
    texts = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert r.decoded_sha256 == sha(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_stages_on_awkward_and_empty_tables(spark, sf_dir, awkward, empty):  # noqa: F811
    for given in (awkward, empty):
        before = collections.Counter(map(tuple, given.collect()))
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, given, sf_dir)
            rows = made.collect()
            if name == "byte-level BPE":
                assert len(rows) == sum(before.values())
                continue
            same_columns(made, given)
            left = collections.Counter(map(tuple, rows))
            assert set(left) <= set(before)
            if name != "mixing":
                assert left <= before
