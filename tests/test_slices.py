"""Python stages work on slices of what Spark sends, with the same rows."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from screenwright.operators import arrow, tfidf
from screenwright.operators.classifier import TfidfModel
from screenwright.operators.clean import clean_html
from screenwright.operators.normalize import compose_unicode
from screenwright.operators.tfidf import TfidfSettings


def test_slices_are_bounded_and_whole():
    texts = pa.array([None, "é" * 70, "", "x" * 300, None, *["ab"] * 500])
    rows = pa.StructArray.from_arrays([texts, texts], names=["a", "b"])
    lists = pa.array([[1, 2], [], list(range(40)), [3]] * 30)
    for whole, parts, size in (
        (texts, list(arrow.text_slices([texts], 100)), lambda part: sum(len((t or "").encode()) for t in part.to_pylist())),
        (rows, list(arrow.struct_slices([rows], 100)), lambda part: sum(len((t or "").encode()) for r in part.to_pylist() for t in r.values())),
        (lists, list(arrow.list_slices([lists], 10)), lambda part: len(part.flatten())),
    ):
        assert sum((part.to_pylist() for part in parts), []) == whole.to_pylist()
        assert all(size(part) <= 100 or len(part) == 1 for part in parts) and len(parts) > 10
    assert list(arrow.text_slices([texts[:0]])) == []


def test_two_columns_are_composed_by_one_stage(spark):
    texts = ["ﬁne", None, "plain", "Ａ" * 400_000, "é ½", ""]
    made = compose_unicode(spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "i int, a string, b string"), "a", "b")
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    form = [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [(r.a, r.b) for r in made.orderBy("i").collect()] == list(zip(form, form[::-1], strict=True))


def test_pages_of_several_slices(spark):
    pages = [(i, f"<title>ﬁ{i}</title><p>{'Ａ' * 50_000}{i}</p>") for i in range(12)]
    found = clean_html(spark.createDataFrame(pages, "i int, html string").coalesce(1)).orderBy("i").select("i", "cleaned.text", "cleaned.title").collect()
    assert [(r.title, r.text.endswith(str(r.i)), len(r.text)) for r in found] == [(f"fi{i}", True, 21 + len(f"fi{i}{i}")) for i in range(12)]


def test_scoring_sends_back_numbers_of_known_terms_only(spark):
    """One stage counts and looks up; weights are those of the terms themselves, in their order."""
    settings = TfidfSettings(min_df=1, max_df=1.0, ngram_range=(1, 3))
    texts = ["Ünder the old bridge the old bridge", "the old", None, "", "zz", "bridge under the bridge", "old the old the old"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame(
        [(t, 1.0 + 0.1 * at, 0.3 * at - 1) for at, t in enumerate(["the", "old", "the old", "under the old", "bridge the", "the old bridge the", "old  the", "z"])],
        "term string, idf double, coefficient double",
    )
    terms = tfidf.terms_of(rows, settings=settings)
    named = terms.select("i", tfidf.known_terms(F.col("terms"), table, ("coefficient",), settings).alias("k")).orderBy("i").collect()
    folded = tfidf.folded_text(rows)
    found = folded.select("i", tfidf.known_weights(F.col("text"), table, "coefficient", settings).alias("k"))
    assert [[(e.weight, e.coefficient) for e in r.k] for r in found.orderBy("i").collect()] == [[(e.weight, e.coefficient) for e in r.k] for r in named]
    assert sum(len(r.k) for r in named) > 10
    plan = TfidfModel(settings, table, 0.1).predict_probabilities(rows, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "term:string" not in plan and plan.count("ArrowEvalPython") == 2
