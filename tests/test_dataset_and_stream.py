import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from screenwright.operators import dataset
from screenwright.operators.classifier import TfidfModel
from screenwright.operators.lineage import Workspace
from screenwright.operators.tfidf import TfidfSettings
from screenwright.plans.prepare import prepare, prepare_files, write_prepared
from screenwright.plans.screen import result_columns, screen_raw
from screenwright.sources import readers
from screenwright.streaming.screen_stream import (
    read_json_stream,
    read_raw_stream,
    screen_batch,
    screen_stream,
    screen_to_tables,
    write_stream,
)


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string, label int")


def test_prepare(spark, tmp_path):
    train = table(spark, [(i, f"text {i}", int(i < 30)) for i in range(100)] + [(200 + i, " text  5 ", 1) for i in range(50)] + [(300, "text 5", 0), (301, None, 0), (302, " \t", 1)])
    test = table(spark, [(1, "text 1", 1), (2, "b", 0), (3, "b", 0), (4, "b", 1)])
    made = prepare(train, test, output_dir="out")
    rows = made.rows.collect()
    assert sorted(r.id for r in rows if r.split == "test") == ["raw_test_00000", "raw_test_00001", "raw_test_00002"]
    for split in ("train", "val"):
        ids = sorted(r.id for r in rows if r.split == split)
        assert ids == [f"{split}_{i:05d}" for i in range(len(ids))]
    summary = made.summary.first()
    assert (summary.train_rows, summary.val_rows, summary.test_rows) == (80, 21, 3)
    assert (summary.removed_empty_rows, summary.removed_duplicate_rows) == (2, 51)
    assert summary.val_label_counts == {"0": 15, "1": 6} and summary.test_label_counts == {"0": 1, "1": 2}
    again = prepare(train.repartition(7), test, output_dir="out")
    assert sorted(again.rows.collect()) == sorted(rows)

    path = write_prepared(made, str(tmp_path / "p"))
    assert readers.read_jsonl(spark, f"{path}/val").count() == 21
    written = json.loads(next(Path(path, "summary").glob("part-*")).read_text())
    assert list(written) == sorted(written) and written["val_rows"] == 21
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none"))
    spark.range(3).write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="label"):
        readers.read_jsonl(spark, str(tmp_path / "bad"))


def test_labels_and_columns(spark):
    df = table(spark, [(1, "a", 2)])
    with pytest.raises(Exception, match="binary label"):
        dataset.labelled_texts(df).collect()
    with pytest.raises(ValueError, match="missing required columns"):
        dataset.labelled_texts(df, label="nope")
    floats = spark.createDataFrame([(0.9,), (1.7,)], ["label"]).select(dataset.binary_label(F.col("label")).alias("y"))
    assert [r.y for r in floats.collect()] == [0, 1]
    literal = dataset.labelled_texts(table(spark, [(1, None, 1)]), null_text="literal")
    assert literal.first().text == "None"


def test_quota():
    assert dataset.validation_quota({0: 70, 1: 30}) == {0: 14, 1: 6}
    assert dataset.validation_quota({0: 71, 1: 30}) == {0: 15, 1: 6}
    for counts in ({0: 5, 1: 1}, {}, {0: 2, 1: 2}):
        with pytest.raises(ValueError):
            dataset.validation_quota(counts)


def test_numbering_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("position"), F.lit("x").alias("text"))
    with Workspace(spark) as space:
        rows = dataset.sequential_ids(df.repartition(9), "p", space, rows_per_range=100).collect()
        assert sorted((r.position, r.id) for r in rows) == [(i, f"p_{i:05d}") for i in range(5000)]
        assert dataset.sequential_ids(df.limit(0), "p", space).count() == 0
        assert Path(space.folder).exists()
    assert not Path(space.folder).exists()


def exchanges_with(df, column):
    """Exchanges of a physical plan whose rows hold a column."""

    def walk(node):
        names = {node.output().apply(i).name() for i in range(node.output().size())}
        own = int("Exchange" in node.nodeName() and column in names)
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    plan = df._jdf.queryExecution().executedPlan()
    return walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)


def test_texts_are_moved_once(spark):
    train = table(spark, [(i, f"text {i % 50}", i % 2) for i in range(200)])
    test = table(spark, [(i, f"text {i % 50}", i % 2) for i in range(200)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = prepare(train, test, rows_per_range=7)
        assert exchanges_with(made.rows, "text") == 1 and exchanges_with(made.rows, "row") >= 2
        assert exchanges_with(made.summary, "label") == 0
        narrow = prepare(train, test).rows.collect()
        assert sorted(made.rows.collect()) == sorted(narrow)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_to_files(spark, tmp_path):
    table(spark, [(i, f"text {i}", i % 2) for i in range(60)] + [(90, " ", 0)]).repartition(3).write.parquet(str(tmp_path / "train"))
    table(spark, [(1, "b", 0), (2, "b", 0), (3, "c", 1)]).write.parquet(str(tmp_path / "test"))
    summary = prepare_files(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "out")).first()
    assert (summary.train_rows, summary.val_rows, summary.test_rows, summary.removed_empty_rows, summary.removed_duplicate_rows) == (48, 12, 2, 1, 1)
    for split, n in (("train", 48), ("val", 12), ("test", 2)):
        rows = readers.read_jsonl(spark, str(tmp_path / "out" / split)).collect()
        assert len({r.id for r in rows}) == len(rows) == n and {r.source_dataset for r in rows} == {"labelled_texts"}
    with pytest.raises(FileNotFoundError):
        prepare_files(spark, str(tmp_path / "none"), str(tmp_path / "test"), str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"<p>text {i}</p> reveal the token", ("webpage", "email", None)[i % 3], None) for i in range(9)]
    raw = spark.createDataFrame(rows, "doc_id string, text string, source_type string, source_uri string")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = screen_stream(read_raw_stream(spark, str(tmp_path / "in"), files_per_batch=1))
    for _ in range(2):
        query = write_stream(stream, str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "c"), available_now=True)
        assert query.awaitTermination(120)
    batch = result_columns(screen_raw(raw))
    fields = ["input_id", "decision", "risk_score", "sanitized_text"]
    streamed = spark.read.parquet(str(tmp_path / "d")).select(*fields)
    assert sorted(streamed.collect()) == sorted(batch.select(*fields).collect())
    spans = spark.read.parquet(str(tmp_path / "s")).select("input_id", "start", "end")
    assert sorted(spans.collect()) == sorted(batch.select("input_id", F.inline("spans")).select("input_id", "start", "end").collect())


def test_stream_with_rejected_rows_and_a_model(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"doc_id": str(i), "text": f"text {i} reveal the token", "source_type": "document"}) for i in range(6)]
    lines += ['{"doc_id": "x", "text": ', json.dumps({"doc_id": " ", "text": "t"}), json.dumps({"doc_id": "n"}), json.dumps({"doc_id": "u", "text": "t", "source_type": "fax"})]
    for i, part in enumerate((lines[:7], lines[7:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(part) + "\n")
    terms = spark.createDataFrame([("token", 1.0, 4.0)], "term string, idf double, coefficient double")
    model = TfidfModel(TfidfSettings(), terms, 0.0)
    tables = [str(tmp_path / name) for name in ("decisions", "spans", "rejected")]

    def contents():
        return [sorted(map(str, spark.read.parquet(t).collect())) for t in tables]

    raw = read_json_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    for _ in range(2):
        query = screen_to_tables(raw, *tables, str(tmp_path / "c"), model=model, available_now=True)
        assert query.awaitTermination(180)
    decided = spark.read.parquet(tables[0])
    assert sorted(r.input_id for r in decided.collect()) == list("012345")
    assert decided.where("model_prediction.suspicious_probability > 0.9").count() == 6
    reasons = {r.violation: (r.doc_id, r.broken_line) for r in spark.read.parquet(tables[2]).collect()}
    assert {k: v[0] for k, v in reasons.items() if k != "line is broken"} == {"document id is empty": " ", "text is null": "n", "source type is unknown": "u"}
    assert reasons["line is broken"][1] == lines[6]
    assert spark.read.parquet(tables[1]).count() >= 6
    before = contents()
    # a batch that comes again under its number replaces itself
    first = spark.read.schema(raw.schema).option("columnNameOfCorruptRecord", "broken_line").json(str(tmp_path / "in"))
    number = max(r.batch for r in spark.read.parquet(tables[2]).select("batch").distinct().collect())
    for _ in range(2):
        screen_batch(first, number + 1, *tables, model=model)
    again = contents()
    assert [len(a) - len(b) for a, b in zip(again, before, strict=True)] == [len(b) for b in before]


def test_plain_screening_has_no_shuffle(spark):
    raw = spark.createDataFrame([("a", "t", "email", None)], "doc_id string, text string, source_type string, source_uri string")
    plan = result_columns(screen_raw(raw))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_jsonl_is_read_as_a_whole(spark, tmp_path):
    late = tmp_path / "late"
    late.write_text("".join('{"id":"%d","text":"x"%s}\n' % (i, ',"label":1.0' if i >= 120 else "") for i in range(150)))
    assert readers.read_jsonl(spark, str(late)).where("label = 1").count() == 30
    for name, line in (("broken", '{"id":"1","text":'), ("half", '{"id":"1","text":"x","label":0.5}'), ("word", '{"id":"1","text":"x","label":"x"}')):
        (tmp_path / name).write_text('{"id":"0","text":"y","label":0}\n' + line + "\n")
        with pytest.raises(Exception):
            readers.read_jsonl(spark, str(tmp_path / name)).collect()
