"""Columns named as the operators' own helper columns, in any case."""

from screenwright.llm.line_dedup import dedup_lines
from screenwright.llm.ngram_join import keep_one

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_lines(spark):
    rows = [(i, f"{TEXT}\nown {i}", 7, 8, 9, 10) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int, Digests_ int, DOC_KEY_ int, n_Dropped int")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "Digests_", "DOC_KEY_", "n_lines", "n_dropped"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert [found[i]["text"] for i in range(6)] == [f"own {i}" for i in range(5)] + [f"{TEXT}\nown 5"]
    assert all(r["n_lines"] == 2 and r["Digests_"] == 8 and r["DOC_KEY_"] == 9 for r in found.values())


def test_one_of_each_group(spark):
    rows = [(1, TEXT, 1, 2, 3, 4), (2, TEXT, 1, 2, 3, 4), (3, "else " + TEXT[::-1], 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_id_ int, GONE_ID_ int, Gone_Digest_ int, TURN_ int")
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
