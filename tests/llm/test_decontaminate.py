"""Benchmark items as a table: against brute force, long and hostile texts."""

import random
import time

from screenwright.llm.decontaminate import SEGMENT, bits_of, budget, decontaminate, find_items, myers, normalise

WORDS = "alpha beta gamma delta omega kappa sigma theta lambda zeta".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", "xy"]) + text[at + rng.randint(0, 1) :]
    return text


def brute(texts, items):
    found = {}
    for d, text in enumerate(texts):
        clean = normalise(text or "")
        for i, raw in items:
            item = normalise(raw or "")
            edits = budget(len(item))
            if not item:
                continue
            if edits == 0:
                if f" {item} " in f" {clean} ":
                    found[d, i] = 0
                continue
            distance = myers(bits_of(item), len(item), clean)[0]
            if distance <= edits:
                found[d, i] = distance
    return found


def test_items_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(40)] + [(40, "a"), (41, "kappa sigma"), (42, None), (43, " - ")]
    texts = [None, "", "a", "x a.", "ab"]
    for i, item in items[:40]:
        texts.append(f"{prose(rng, 15)} {edited(rng, item, rng.randint(0, 5))} {prose(rng, 60)}")
        texts.append(edited(rng, item, budget(len(item))))
    texts += texts[5:9]  # equal texts
    docs = spark.createDataFrame([(d, t, "s", 0) for d, t in enumerate(texts)], "doc_id long, text string, Text_Id string, BLOCK int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number int")
    want = brute(texts, items)
    rows = find_items(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in rows} == want and len(rows) == len(want) > 60
    for r in rows:
        piece, item = normalise(texts[r["doc_id"]][r["begin"] : r["end"]]), normalise(items[r["item_id"]][1])
        assert myers(bits_of(item), len(item), piece)[0] == r["distance"]
    split = find_items(docs.repartition(5), bench, block_chars=900).collect()
    assert sorted(split) == sorted(rows)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert find_items(docs, bench.limit(0)).count() == 0 and find_items(docs.limit(0), bench).count() == 0


def test_long_texts_and_repeated_words(spark):
    rng = random.Random(12)
    item = prose(rng, 30)
    long = "z" * (SEGMENT - 60) + " " + item + " " + "y" * SEGMENT + " " + item[:70] + "#" + item[72:]
    docs = spark.createDataFrame([(1, long), (None, "q " + item), (2, "w")], "doc_id long, text string")
    found = find_items(docs, spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["begin"], r["distance"]) for r in sorted(found, key=lambda r: r["doc_id"] or 0)] == [(None, 2, 0)] * 2 + [(1, SEGMENT - 59, 0)] * 2
    # an item that begins with a repeated word, in texts of that word: one pass over each text
    hostile = "word " * 400 + prose(rng, 400)
    docs = spark.createDataFrame([(n, "word " * n) for n in (1000, 4000, 40000)], "doc_id long, text string")
    start = time.time()
    assert find_items(docs, spark.createDataFrame([(1, hostile)], "item_id long, text string")).count() == 0
    assert time.time() - start < 60
