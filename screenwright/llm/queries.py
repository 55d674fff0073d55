"""One query per operator over its whole table, and SQL counterparts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright.functions.core import let
from screenwright.llm.chat_format import CLOSE, CONTROL, END, OPEN, format_chats, read_loss, read_turns
from screenwright.llm.common import held_out, table
from screenwright.llm.decontaminate import find_items
from screenwright.llm.filter_audit import audit_filters
from screenwright.llm.language import identify_language, learn_samples
from screenwright.llm.line_dedup import dedup_lines
from screenwright.llm.near_vectors import link_vectors
from screenwright.llm.ngram_join import join_similar
from screenwright.llm.packing import pack
from screenwright.llm.periodic_runs import find_runs
from screenwright.llm.quality import learn_quality, score_quality
from screenwright.llm.sharding import shuffle_into_shards
from screenwright.llm.token_count import count_tokens
from screenwright.llm.toxicity import FOLDS, HELD_OUT, learn_toxicity, score_toxicity

SHARDS = 24
PROBE = f"{END}{OPEN} ok {CLOSE}"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
                    for i, role in enumerate(("user", "assistant"))
                )
            )
        )
    )
    chats = format_chats(turns.unionByName(extra))
    turn_list, loss = F.col("turns"), F.col("loss")
    read = chats.select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(
                    read_turns(F.col("formatted")).alias("turns"),
                    read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                    F.length("formatted").cast("long").alias("formatted_chars"),
                )
            )
        ),
    )
    said = F.array_join(F.transform(turn_list, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size(turn_list).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), learn_samples(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    crc = F.crc32("input_ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = shuffle_into_shards(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted", "spans")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of one id in ten by its crc, from a word on replaced by repetitions of the words from there."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    step = F.floor(crc / 10)

    def planted(words):
        n = F.size(words)

        def at(place):
            period = F.floor((n - place) / (3 + step % 8)) + 1
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < place, i).otherwise(place + (i - place) % period) + 1).cast("int")))

        return F.when(n > 0, F.array_join(let(step % n, at), " ")).otherwise(F.col("text"))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.withColumn("text", F.when(crc % 10 == 0, let(words, planted)).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", runs, "collapsed", longest.alias("best")).select("*", "best.length", (-F.col("best.col2")).alias("start"), (-F.col("best.col3")).alias("period"))
    return best.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit_filters(docs, table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_near_vectors,
        op3_line_dedup,
        op4_ngram_join,
        op5_token_count,
        op6_language,
        op7_decontaminate,
        op8_pack,
        op9_shards,
        op10_quality,
        op11_toxicity,
        op12_periodic_runs,
        op13_filter_audit,
    )
}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for word in CONTROL:
        out = f"replace({out}, '{word}', '{word[0]}\\{word[1:]}')"
    return out


_CHAT = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN length('<s></s>') + length({_escaped("role")}) ELSE 0 END
    + length('[INST][/INST]') + length({_escaped("text")}) AS n
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

_COMPONENTS = """
reach(id, to_id) AS (
  SELECT a, b FROM links
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
)"""

_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), unit AS (
  SELECT vec_id, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) AS u FROM usable
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.9
), {_COMPONENTS}, found AS (
  SELECT id, min(to_id) AS low FROM reach GROUP BY id
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON vec_id = a LEFT JOIN found ON vec_id = id"""

_LINES = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parts
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_SIMILAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END)) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)
), {_COMPONENTS}, found AS (
  SELECT id, min(to_id) AS low FROM reach GROUP BY id
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_links, least(doc_id, coalesce(low, doc_id)) AS component_id,
  least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN counted ON doc_id = a LEFT JOIN found ON doc_id = id"""

_CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))
  ))"""

_RUNS = f"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (
  SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), planted AS (
  SELECT row, doc_id, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM placed
), words AS (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM planted
), pairs AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT row, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) AS place FROM runs
), listed AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    max(start) FILTER (place = 1) AS start, max(length) FILTER (place = 1) AS length, max(period) FILTER (place = 1) AS period
  FROM ranked GROUP BY row
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = w.row AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON l.row = p.row LEFT JOIN kept ON kept.row = p.row"""

_AUDIT = """
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), lowest AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS low FROM documents GROUP BY ALL
), measured AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(d.text, '') AS text, low,
    regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents d JOIN lowest l ON coalesce(d.text, '') = l.text
), labelled AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN m.doc_id > low THEN 'E' ELSE '' END AS failed
  FROM measured m LEFT JOIN labelled l ON m.doc_id = l.doc_id
), patterns AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, failed
), laid AS (
  SELECT *, contains(failed, letter) AS fails, length(translate(earlier, failed, '')) < step - 1 AS gone FROM patterns, steps
), found AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
    CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed = letter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM laid GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE letter, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM found"""

ORACLES = {
    "op1_chat_format": _CHAT,
    "op2_near_vectors": _VECTORS,
    "op3_line_dedup": _LINES,
    "op4_ngram_join": _SIMILAR,
    "op12_periodic_runs": _RUNS,
    "op13_filter_audit": _AUDIT,
}
