"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from corpus import CLASHING, edge_rows, frame, labels, prose, taken

import corpus_pipeline
from demandloom.llm import (decontamination, line_dedup, lm_scoring, packing, quality, secrets, simhash, substring_dedup,
                            toxicity)

MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (11, 5, 7), (9, 1, 0), (9, 1, 0), (404, 0, 0)]


def items(spark):
    return spark.createDataFrame(
        [(1, prose(1, 120)[:300]), (2, prose(1, 120)[:300]), (3, None), (None, prose(1, 120)), (4, ""), (5, "two words")], "item_id long, text string")


OPERATORS = {
    "lines": lambda spark, docs: line_dedup.report(docs),
    "quality": lambda spark, docs: quality.quality(docs, labels(spark, MARKS)),
    "simhash": lambda spark, docs: simhash.classes(docs, 3, 2),
    "passages": lambda spark, docs: substring_dedup.passages(docs),
    "scores": lambda spark, docs: lm_scoring.scored(docs.coalesce(1)).selectExpr("doc_id", "words", "round(log_prob, 3)", "round(mean_log_prob, 3)"),
    "toxicity": lambda spark, docs: toxicity.toxicity(docs, labels(spark, MARKS)),
    "packing": lambda spark, docs: packing.pack(docs, packing.byte_bpe()).drop("sequence_id", "offset", "start", "length", "ids").distinct(),
    "secrets": lambda spark, docs: secrets.scan(docs),
    "leaks": lambda spark, docs: decontamination.contaminated(docs, items(spark)),
}
# A row for each row of the documents, or fewer.
WHOLE = ("lines", "quality", "simhash", "scores", "toxicity", "secrets")


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_edge_rows(spark, name):
    rows = edge_rows()
    plain = taken(OPERATORS[name](spark, frame(spark, rows)))
    assert plain == taken(OPERATORS[name](spark, frame(spark, rows, CLASHING)))
    if name in WHOLE:
        assert sorted(repr(r[0]) for r in plain) == sorted(repr(r[0]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(spark, name):
    assert taken(OPERATORS[name](spark, frame(spark, []))) == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels(spark, MARKS).write.parquet(f"{path}/labels.parquet")
    items(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("extra", [(), CLASHING])
def test_stages_on_edge_rows(spark, folder, extra):
    docs = frame(spark, edge_rows(), extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        kept[name] = taken(found.select("doc_id", "text"))
    # Classes of exact copies leave one; rows without doc_id stay.
    assert [r[0] for r in kept["near_dedup"]].count(1) == 1 and 2 not in [r[0] for r in kept["near_dedup"]]
    assert [r[0] for r in kept["near_dedup"]].count(None) == 2
    assert {r[0] for r in kept["decontamination"]} == {None, 3, 4, 5, 6, 7, 8, 9, 10}
    # The first copy keeps its text, the later ones lose theirs; the row that repeats doc_id 1 is document 1, too.
    lines = {r[0]: r[1] for r in kept["line_dedup"] if r[0] is not None}
    assert lines[1] == prose(1, 120) and lines[2] == "" and lines[3] is None and lines[8] == "\n" * 50
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_stages_on_an_empty_table(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder).count() == 0


def test_stages_without_labels_or_items(spark, tmp_path):
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, edge_rows())
    assert corpus_pipeline.accept_quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).count() == docs.count()
    assert toxicity.toxicity(docs, labels(spark, [])).where("toxic > 0.5").count() == 0
