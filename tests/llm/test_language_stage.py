"""The pipeline's language stage decides by prediction and score, and tells the language of unlabelled documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from screenwright.llm import language

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": "kato loma risu tela mopi kanu".split(), "bb": "wrsch drynk splomf grtz knarf vlask".split()}


def test_unwanted_languages_go_and_unlabelled_documents_get_theirs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=30)), None if i % 5 == 0 else lang, "s", 1))
    rows += [(500, None, "aa", "s", 0), (501, "12 34", "aa", "s", 5), (502, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == {i: "aa" if i % 2 else "bb" for i in range(200)}
    only = corpus_pipeline.known_language(spark, docs, "", wanted=("bb",))
    assert only.columns == docs.columns and {r.doc_id for r in only.collect()} == set(range(0, 200, 2))
    assert corpus_pipeline.known_language(spark, docs, "", least=1.0).count() == 0
    unlabelled = corpus_pipeline.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert {r.lang for r in unlabelled.collect()} == {None} and unlabelled.where("doc_id < 200").count() == 200


def test_only_the_last_table_of_a_run_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda spark, name: str(tmp_path / name))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name for p in (tmp_path / "pipeline").iterdir()] == [corpus_pipeline.STAGES[-2][0]]


def test_scripts_of_many_letters():
    """Languages over the same 1,500 Han letters, over Hangul, Cyrillic and Latin letters, by unseen texts of 8 words."""
    rng = random.Random(31)
    han, hangul = [chr(0x4E00 + i) for i in range(1500)], [chr(0xAC00 + i) for i in range(1200)]
    cyrillic, latin = [chr(0x430 + i) for i in range(32)], list("abcdefghijklmnopqrstuvwxyz")
    scripts = {"han1": (han, 2), "han2": (han, 2), "hangul": (hangul, 3), "cyrillic": (cyrillic, 6), "latin": (latin, 6)}
    words = {k: ["".join(rng.choice(letters) for _ in range(n)) for _ in range(2000)] for k, (letters, n) in scripts.items()}

    def text(language, n):
        return " ".join(rng.choice(words[language]) for _ in range(n))

    samples = {k: [text(k, 200) for _ in range(64)] for k in scripts}
    letters = {c for texts in samples.values() for t in texts for c in t} - {" "}
    model = language.Model(samples)
    assert len({(model.symbols.of[ord(c)], model.symbols.then[ord(c)]) for c in letters}) == len(letters) > 2700
    assert model.table.nbytes <= language.MODEL_BYTES * 1.01
    unseen = [(k, text(k, 8)) for k in scripts for _ in range(150)]
    found, scores = model.predict([t for _, t in unseen])
    right = {k: sum(f == k for f, (own, _) in zip(found, unseen, strict=True) if own == k) / 150 for k in scripts}
    assert min(right.values()) >= 0.97, right
    assert all(0 < s <= 1 for s in scores)
    assert model.predict(["", "12 !"])[0] == ["und"] * 2
    assert model.predict(["ا ب"])[0][0] in scripts  # letters that no sample holds
