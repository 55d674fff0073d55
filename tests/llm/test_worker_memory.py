"""Python workers serve one stage after another; they keep the tables of the stage they last served only."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from screenwright.llm import common, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(spark) -> set[tuple]:
    """Kinds of tables that each worker holds which answers."""

    def ask(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"kinds": [",".join(sorted(key[0] for key in common._held))]})

    return {tuple(r.kinds.split(",")) for r in spark.range(64).repartition(16).mapInArrow(ask, "kinds string").collect()}


def test_a_worker_holds_the_tables_of_one_stage(spark):
    words = {"aa": "kato loma risu tela mopi kanu", "bb": "wrsch drynk splomf grtz knarf vlask"}
    rows = [(i, f"{words[lang]} {i}", lang, "s", 1) for i in range(64) for lang in words]
    docs = spark.createDataFrame(rows, DOCS).repartition(16)
    assert corpus_pipeline.known_language(spark, docs, "").count() == len(rows)
    assert ("language",) in _kept(spark)
    assert corpus_pipeline.packed(spark, docs, "").count() >= len(rows)
    found = _kept(spark)
    assert ("words",) in found and found <= {("words",), ("language",), ("",)}
    corpus_pipeline.without_repeated_lines(spark, docs, "").count()
    assert ("",) in _kept(spark)


def test_one_table_is_held():
    made = []
    for key in ("a", "a", "b", "a"):
        assert common.held(key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "a"]
    common.let_go()
    assert not common._held


def test_the_words_that_packing_remembers_are_bounded():
    assert packing.REMEMBERED <= 1 << 17
