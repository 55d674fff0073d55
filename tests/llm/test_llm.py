"""Operators for training data against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from screenwright.llm import language, packing, quality, sharding, token_count
from screenwright.llm.chat_format import END, OPEN, escape, format_chats, read_loss, read_turns, unescape
from screenwright.llm.components import connected_components
from screenwright.llm.decontaminate import bits_of, decontaminate, find_items, myers, normalise, normalise_at
from screenwright.llm.line_dedup import dedup_lines
from screenwright.llm.near_vectors import link_vectors
from screenwright.llm.ngram_join import compare_sets, join_similar, keep_one, shingles
from screenwright.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta omega kappa sigma theta lambda zeta".split()


def docs(spark, texts, ids=None, lang=None):
    ids = ids or range(len(texts))
    rows = [(i, t, lang and lang[k], "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def test_chats_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>\\", "[\\INST]\\\\", "", None, "é\n<s>"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(hard)]
    rows += [(2, 0, None, "x"), (2, 0, "assistant", "y"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, None, "user", None)]
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted long")
    out = format_chats(table).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    found = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["l"], r["formatted"]) for r in out.collect()}
    assert found[1][0] == [(r[2], r[3] or "") for r in rows[:6]]
    assert found[1][1] == "".join(r[3] or "" for r in rows[:6] if r[2] == "assistant")
    assert found[2][0] == [("", "x"), *[("assistant", "y")] * 3] and found[2][1] == "yyy"
    assert found[2][2].count(END) == 2 and found[2][2].count(OPEN) == 4  # adjacent turns of one role share a block
    assert found[None][0] == [("user", "")]
    assert format_chats(table.limit(0)).count() == 0
    frame = spark.createDataFrame([(h or "",) for h in hard], "x string")
    assert frame.where(unescape(escape(F.col("x"))) != F.col("x")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 201 + k) for k in range(30)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {r["id"]: r["component"] for r in connected_components(table, "a", "b").collect()}
    assert found == {i: root(i) for a, b in links if a != b for i in (a, b)}
    assert connected_components(table.limit(0), "a", "b").count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [b + rng.normal(size=8) * s for b in base for s in (0.02, 0.1, 0.3)] + [base[0]] * 3
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [(500, None), (501, [0.0] * 8), (502, [math.nan] * 8), (503, [None] * 8), (504, []), (505, [1.0] * 3), (506, [2.0] * 3), (None, table[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in table + odd], "vec_id long, embedding array<double>, n_links int")
    found = {r["vec_id"]: r for r in link_vectors(frame).collect()}
    assert len(found) == len(table) + len(odd)
    x = np.array([v for _, v in table])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for i in range(len(x)):
        reach, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - reach
            reach |= new
            todo += new
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (near[i].sum(), min(reach), i == min(reach))
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (500, 501, 502, 503, 504, None))
    assert found[506]["component_id"] == 505
    assert link_vectors(frame.limit(0)).count() == 0


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    common = ["x" * 40 + str(k) for k in range(6)] + ["é" * 39, "é" * 40, " " + "X" * 40 + "0\t"]
    texts = ["\n".join(rng.choice([*common, prose(rng, 8), "short", ""]) for _ in range(rng.randint(1, 12))) for _ in range(60)] + [None, "", "\n"]
    ids = [*range(60), 60, None, 3]
    found = dedup_lines(docs(spark, texts, ids).withColumn("n_dropped", F.lit("x")))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    holders = defaultdict(set)

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if c.isascii() else c for c in k)

    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    keeper = {k: max(i for i in s if i is not None) for k, s in holders.items() if len(k) >= 40 and len(s) >= 5}
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == want
    assert keeper and dedup_lines(docs(spark, ["a"]).limit(0)).count() == 0


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = prose(rng, rng.choice([3, 6, 60, 400])).split()
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts += [" ".join(words), "\n".join(copy).upper()]
    texts += [None, "", " ", "one", "one", "one two"]
    ids = list(range(len(texts)))

    def grams(t):
        w = [x for x in re.split(r"[\t-\r ]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    near = {i: {j for j in ids if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} for i in ids}
    found = {r["doc_id"]: r for r in join_similar(docs(spark, texts), block=4).collect()}
    for i in ids:
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert (found[i]["n_links"], found[i]["component_id"]) == (len(near[i]), min(reach)), i
    repeated = docs(spark, [*texts, "one", "one", None], [*ids, 3 + len(texts) - 6, None, None])
    kept = keep_one(repeated)
    assert kept.columns == repeated.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == Counter([i for i in ids if found[i]["kept"]] + [None, None])
    assert join_similar(docs(spark, ["a"]).limit(0)).count() == 0
    a, b = [np.arange(10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64)]
    assert compare_sets([a, b], 0.8)[0, 1] and not compare_sets([a, b[1:]], 0.8)[0, 1]
    assert shingles([])[0].size == 0


def test_ngram_join_with_several_texts_under_one_id(spark):
    rng = random.Random(16)
    a, b, c = (prose(rng, 80) for _ in range(3))
    near_a, near_c = f"{a} changed", f"{c} changed"
    rows = [(3, a), (7, a), (7, b), (8, near_a), (8, c), (9, c), (9, near_c), (11, b.upper()), (12, c), (12, near_c), (13, "x y"), (13, "X  y"), (13, None), (13, "")]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = Counter((r["doc_id"], r["text"]) for r in keep_one(frame, block=2).collect())
    assert kept[(3, a)] == kept[(7, b)] == kept[(8, c)] == kept[(13, None)] == kept[(13, "")] == 1
    assert kept[(13, "x y")] + kept[(13, "X  y")] == 1 and kept.total() == 6
    found = Counter(map(tuple, join_similar(frame, block=2).collect()))
    want = [(3, 2, 3, True), (7, 2, 3, False), (7, 1, 7, True), (8, 2, 3, False), (8, 4, 8, True), *[(9, 4, 8, False)] * 2, (11, 1, 7, False), *[(12, 4, 8, False)] * 2]
    assert found == Counter([*want, (13, 1, 13, True), (13, 1, 13, False), *[(13, 0, 13, True)] * 2])
    many = docs(spark, [prose(rng, 40) for _ in range(300)], [5] * 300)
    assert keep_one(many).count() == 300


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, words = token_count.load_tokenizer(path)
    parts = ["a b", " x", "  y\n z", "\t", "\n\n q", "don't 's", "é  b \x1c c", "1 2  34", " ", "日本 語", "a ́b", "Wört!,", "\nx", "ß.'", "<|endoftext|>"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    found = token_count.count_tokens(docs(spark, [*texts, None]), path, limit=20, chunk=24, overlap=4).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in found] == [*want, 0]
    assert [r["n_bytes"] for r in found] == [len(t.encode()) for t in texts] + [0]
    assert [r["over_limit"] for r in found] == [n > 20 for n in want] + [False]
    long = "x" * 5000 + " word" * 3000
    assert token_count.spliced_count(long, tokenizer, 256, 16) == len(tokenizer.encode(long, add_special_tokens=False))


def test_language(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").limit(4).collect()]
    model = language.Model({"en": [texts[0]], "xx": ["zq zqq qzz " * 20]})
    for text in texts[1:]:
        rows = model.symbols.encode(text)
        for k, sample in enumerate([texts[0], "zq zqq qzz " * 20]):
            source, count = bytes(model.symbols.encode(sample)), 0
            for at in range(0, len(rows), language.ROW):
                row, i = bytes(rows[at : at + language.ROW]), 0
                while i < len(row):
                    j = i + 1
                    while j < len(row) and row[i : j + 1] in source:
                        j += 1
                    count, i = count + 1, j
            n = -(-len(rows) // language.ROW)
            table = np.zeros((n, language.ROW), np.uint8)
            table.ravel()[: len(rows)] = rows
            lengths = np.minimum(language.ROW, len(rows) - np.arange(0, len(rows), language.ROW))
            assert model.phrases(table, lengths)[k].sum() == count
    frame = docs(spark, [None, "", "12 !", texts[0], texts[0]]).withColumn("score", F.lit("x"))
    found = language.identify_language(frame, {"en": texts, "xx": ["zq zqq"]}).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == ["und"] * 3 + ["en"] * 2 and found[0]["score"] == 0
    assert {r["lang_pred"] for r in language.identify_language(frame, {}).collect()} == {"und"}
    assert language.learn_samples(frame.limit(0)) == {}


def test_language_samples_reach_over_whole_texts(spark):
    header = "licence " * 100
    frame = docs(spark, [header + "wort " * 300, header + "mot " * 300, "kurz"], [0, 1, 4], ["de", "fr", "de"])
    samples = language.learn_samples(frame)
    assert any("wort wort" in t for t in samples["de"]) and any("mot mot" in t for t in samples["fr"]) and "kurz" in samples["de"]
    assert all(len(t) <= language.SAMPLE_CHARS + language.PLACES - 1 for texts in samples.values() for t in texts)
    texts = [letters * 100 for letters in ("bcd ", "fgh ", "xyz ")]
    for count in (1, 2, 20):
        model = language.Model({f"l{i:02}": texts for i in range(count)}, model_bytes=count * 40_000)
        assert len(model.table) * 4 <= count * 40_000 + 4 * model.symbols.count * (count + 1)
        for word in ("bcd", "fgh", "xyz"):
            row = model.symbols.encode(word)
            assert set(model.phrases(row[None, :], np.array([3])).ravel()) == {1}


def test_language_with_a_small_sample(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["text"], r["lang"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in frame.collect()]
    unseen = [t for t, lang, held in rows if lang == "es" and held]
    short = min((t for t, lang, held in rows if lang == "es" and not held), key=len)
    found, _ = language.Model({**language.learn_samples(frame), "es": [short]}).predict(unseen)
    assert len(short) < 100 and found.count("es") >= 0.9 * len(unseen)


def test_language_stage_rejects_only_texts_without_a_letter(spark):
    stage = dict(corpus_pipeline.STAGES)["language"]
    texts = ["one text", "ein Text", "日本", None, "", "12 !"]
    apart = [i for i in range(99) if zlib.crc32(str(i).encode()) % 4 == 2][: len(texts)]
    unlabelled, held_out = docs(spark, texts), docs(spark, texts, apart, ["en"] * len(texts))
    named_und = docs(spark, texts, lang=["und"] * len(texts))
    for frame in (unlabelled, held_out, named_und):
        kept = stage(spark, frame, SMALL)
        assert kept.columns == frame.columns
        assert sorted(r["text"] for r in kept.collect()) == sorted(texts[:3])
    scores = [r["score"] for r in language.identify_language(unlabelled, {}).orderBy("doc_id").collect()]
    assert scores == [None] * 3 + [0.0] * 3


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_quality(spark):
    rng = np.random.default_rng(1)
    for _ in range(10):
        n, tie = int(rng.integers(1, 6)), float(rng.normal())
        e = rng.normal(size=n) * 2
        total, good = 0.0, np.zeros(n)
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = math.exp(sum(e[i] for i in range(n) if y[i]) + tie * sum(y[i] == y[i + 1] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(quality.marginals(np.append(e, 1.0), np.array([n, 1]), tie)[0][:n], good / total)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.9 * len(rows)
    model = quality.LineModel.fit(["A good line.\nmore of it", "BAD!! BAD!!"], [1, 0])
    frame = docs(spark, [None, "", "A good line.", "\n\n"]).withColumn("predicted", F.lit("x"))
    found = quality.score_quality(frame, model).orderBy("doc_id").collect()
    assert found[0]["score"] == found[1]["score"] and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_quality(frame, quality.LineModel.fit([], [])).first()["score"] == 0.5


def test_quality_learns_from_whole_texts(spark):
    start = [f"This is a good line number {i} of a text." for i in range(100)]
    text = "\n".join([*start, *["JUNK!! || 77"] * 100])
    part = quality.excerpt(text, 3000)
    assert 2900 <= len(part) <= 3000 and "JUNK!! || 77" in part.split("\n") and start[0][:20] in part
    assert quality.excerpt("short\n\ntext", 3000) == "short\n\ntext"
    assert len(quality.excerpt("x" * 9000, 3000)) == 3000 >= len(quality.excerpt("\n" * 9000, 3000))
    seen, fit = [], quality.LineModel.fit
    quality.LineModel.fit = lambda texts, *rest: seen.extend(texts)
    try:
        labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
        quality.learn_quality(docs(spark, [text], [1]), labels)
    finally:
        quality.LineModel.fit = fit
    assert seen == [part]


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, c in enumerate(t):
            new.append(min(row[j] + (a != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    for _ in range(150):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert myers(bits_of(p), len(p), t)[0] == edit_distance(p, t)
    item = prose(rng, 30)
    broken = item[:50] + "?" + item[51:90] + item[92:]
    far = "".join(c if i % 6 else "#x" for i, c in enumerate(item))
    texts = ["ab " + item.upper().replace(" ", " - ") + " cd", broken, far, None, "", prose(rng, 40), "it is yes.", "yesterday"]
    bench = spark.createDataFrame([(1, item), (2, "Yes!"), (3, None), (4, " ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in find_items(docs(spark, texts), bench).collect()}
    want = {(i, 1) for i, t in enumerate(texts) if t and edit_distance(normalise(item), normalise(t)) <= len(normalise(item)) // 16}
    assert set(found) == want | {(6, 2)} and {(0, 1), (1, 1)} <= want and (2, 1) not in want
    assert texts[0][found[(0, 1)]["begin"] : found[(0, 1)]["end"]] == item.upper().replace(" ", " - ")
    assert all(normalise_at(t)[0] == normalise(t) for t in texts if t)
    clean = decontaminate(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5, 7]
    assert decontaminate(docs(spark, texts), bench.limit(0)).count() == len(texts)
    several = find_items(docs(spark, texts), bench, block_chars=1)
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} == set(found)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.load_words(path)
    rng = random.Random(9)
    for _ in range(60):
        positions = [0]
        for _ in range(rng.randint(1, 30)):
            positions.append(positions[-1] + rng.randint(1, 16))
        penalties = [rng.choice([0, 2, 5]) for _ in positions]
        best = [0] + [10**9] * (len(positions) - 1)
        for j in range(1, len(best)):
            for i in range(j):
                if positions[j] - positions[i] <= 16:
                    best[j] = min(best[j], best[i] + packing.padding(positions[j] - positions[i], 16) + penalties[j])
        cost = last = 0
        for j in packing.best_cuts(positions, penalties, 16):
            cost += packing.padding(positions[j] - positions[last], 16) + penalties[j]
            last = j
        assert cost == best[-1]
    texts = [None, "", "word " * 9000, *[prose(rng, rng.randint(1, 900)) + ". Ünd!\t日本  x" for _ in range(30)], "same", "same"]
    ids = [*range(len(texts) - 1), None]
    pieces = packing.pack(docs(spark, texts, ids).repartition(3), path).collect()
    whole, filled = defaultdict(dict), defaultdict(dict)
    for r in pieces:
        got = np.frombuffer(r["input_ids"], "<u4")
        assert len(got) == r["length"]
        whole[r["doc_id"]][r["start"]] = got
        filled[r["sequence_id"]][r["offset"]] = r["length"]
    for i, t in zip(ids, texts, strict=True):
        want = [*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.concatenate([v for _, v in sorted(whole[i].items())]).tolist() == want
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts.items()):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert packing.pack(docs(spark, ["a"]).limit(0), path).count() == 0


def test_shards(spark):
    counts = [100, 0, 57, 1000, 3]
    matrix = sharding.communication_matrix(counts, 24, 1)
    assert [sum(r) for r in matrix] == counts and {sum(c) for c in zip(*matrix, strict=True)} <= {48, 49}
    rng = random.Random(5)
    drawn = Counter(sharding.hypergeometric(rng, 5, 7, 6) for _ in range(20000))
    for k in range(6):
        assert abs(drawn[k] / 20000 - math.comb(5, k) * math.comb(7, 6 - k) / math.comb(12, 6)) < 0.02
    table = docs(spark, [None, "", *["x"] * 200, *map(str, range(300))], [1] * 200 + [None] * 2 + list(range(300))).withColumn("shard", F.lit("old"))
    out = sharding.shuffle_into_shards(table.repartition(5), 7).collect()
    sizes = defaultdict(list)
    for r in out:
        sizes[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and len(s) in (71, 72) for s in sizes.values()) and len(sizes) == 7
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in table.collect())
    assert sharding.shuffle_into_shards(table.limit(0), 7).count() == 0
    plan = sharding.shuffle_into_shards(table, 7)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_against_its_operators(spark, tmp_path):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in frame.collect()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    extra = [(90001, None, "en", "s", 0), (90002, "12 34", "en", "s", 5), (90003, f"Intro. {benchmark[0]} End.", "en", "s", 9), (90004, rows[0][1], "en", "s", 9)]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "ngram_join", "decontaminate", "pack"]
    now = spark.createDataFrame(rows + extra, frame.schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SMALL).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "pack":
            assert now.columns == frame.columns
    ids = {name: {r["doc_id"] for r in t.select("doc_id").collect()} for name, t in seen.items()}
    everything = {r[0] for r in rows + extra}
    assert ids["language"] == everything - {90001, 90002}
    assert ids["line_dedup"] == ids["language"] and 90004 not in ids["ngram_join"]
    dirty = {r["doc_id"] for r in seen["ngram_join"].collect() if any(edit_distance_within(normalise(b), normalise(r["text"])) for b in benchmark)}
    assert ids["decontaminate"] == ids["ngram_join"] - dirty and 90003 in dirty
    assert ids["pack"] == ids["decontaminate"]
    pieces = corpus_pipeline.run(spark, SMALL)
    digest = hashlib.sha256(str(sorted(map(tuple, pieces.select("doc_id", "start", "length").collect()))).encode()).hexdigest()
    again = corpus_pipeline.run(spark, SMALL)
    assert digest == hashlib.sha256(str(sorted(map(tuple, again.select("doc_id", "start", "length").collect()))).encode()).hexdigest()


def edit_distance_within(item, text):
    """Whether an item occurs with at most a sixteenth of edits; plain dynamic programming by numpy rows."""
    if item in text:
        return True
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(t) + 1, np.int64)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(item):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
        new = np.concatenate([[i + 1], new])
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= len(item) // 16


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_near_vectors", "op3_line_dedup", "op4_ngram_join"])
def test_against_sql(spark, name):
    import duckdb

    from screenwright.llm.queries import ORACLES

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    answer = connection.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert Counter(map(tuple, answer.fetchall())) == Counter(map(tuple, QUERIES[name](spark, SMALL).select(*columns).collect()))
