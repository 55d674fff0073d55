"""SQL counterparts of the queries, for DuckDB.

Every text is built from the rules' definitions, not from the Spark code. All
of them run over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from checks.queries import CUSTOM_RULES, CUSTOM_WEIGHTS, GATED_RULES, METRICS
from checks.views import MODEL_BIAS, NOISY_SQL, SCORED_SQL, SEEDED_SQL
from screenwright.constants import (
    BANDS,
    CATEGORY_NAMES,
    CATEGORY_WEIGHTS,
    CONTEXT_HEADER,
    DEFAULT_RULES,
    LEVEL_OF_BAND,
    REMOVAL_MARKER,
    THRESHOLDS,
    TRUNCATION_SUFFIX,
    WHITESPACE,
    Rule,
)

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    """SQL string literal; characters beyond printable ASCII are given by number."""
    parts, plain = [], ""
    for char in text:
        if " " <= char <= "~":
            plain += char.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(char)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")"


def dbl(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


WS = lit(WHITESPACE)
WS_CLASS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# --- spans -------------------------------------------------------------------


def raw_spans(rules: Sequence[Rule], detector: str, key: str = "doc_id") -> str:
    """Matches with offsets: what lies before a match is the sum of pieces and matches before it."""
    arms = []
    for number, rule in enumerate(rules, start=1):
        pattern = lit("(?ims)" + rule.pattern)
        arms.append(f"""
        SELECT {key}, {number} AS rule_no, {lit(rule.category)} AS category, {dbl(rule.score)} AS score,
               {lit(rule.reason)} AS reason, {lit(detector + ":" + rule.name)} AS detector_name,
               regexp_extract_all(text, {pattern}) AS m, regexp_split_to_array(text, {pattern}) AS g
        FROM texts WHERE regexp_matches(text, {pattern})""")
    return f"""
    found AS ({" UNION ALL ".join(arms)}),
    numbered AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found),
    raw_spans AS (
        SELECT {key}, rule_no, category, score, reason, detector_name,
               trim(m[i], {WS}) AS span_text,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start,
               length(m[i]) AS span_length
        FROM numbered),
    spans AS (
        SELECT * EXCLUDE (span_length), CAST(start + span_length AS INT) AS "end" FROM raw_spans
        WHERE span_text <> ''
        QUALIFY row_number() OVER (PARTITION BY {key}, start, start + span_length, category ORDER BY score DESC, rule_no) = 1)"""


def weight_case(weights: dict[str, float]) -> str:
    arms = " ".join(f"WHEN {lit(name)} THEN {dbl(w)}" for name, w in weights.items())
    return f"CASE category {arms} ELSE {dbl(0.1)} END"


def scores(weights: dict[str, float] = CATEGORY_WEIGHTS, key: str = "doc_id", source: str = "spans") -> str:
    return f"""
    category_scores AS (
        SELECT {key}, category,
               greatest({dbl(0.0)}, least({dbl(1.0)}, max(score) + least({dbl(0.15)}, {dbl(0.03)} * (count(*) - 1)))) AS score,
               CAST(count(*) AS INT) AS evidence_count
        FROM {source} GROUP BY {key}, category),
    weighted AS (
        SELECT {key}, sum(score * w ORDER BY category) / sum(w ORDER BY category) AS risk,
               string_agg(category, ',' ORDER BY category) AS categories,
               CAST(sum(evidence_count) AS BIGINT) AS span_count, count(*) AS category_count
        FROM (SELECT *, {weight_case(weights)} AS w FROM category_scores) GROUP BY {key})"""


RISKS = """
    risks AS (
        SELECT t.* EXCLUDE (text), t.text AS text, coalesce(w.risk, CAST(0 AS DOUBLE)) AS risk,
               coalesce(w.categories, '') AS categories,
               coalesce(w.span_count, 0) AS span_count, coalesce(w.category_count, 0) AS category_count
        FROM texts t LEFT JOIN weighted w USING (doc_id))"""


def by_band(score: str, column: int, floor: bool = False) -> str:
    value = [dict(zip(("name", "decision"), (b[0], b[3]), strict=True)) for b in BANDS]
    names = [(LEVEL_OF_BAND[v["name"]], v["name"], v["decision"])[column] for v in value]
    arms = "".join(
        f" WHEN {score} BETWEEN {dbl(low)} AND {dbl(high)} THEN '{n}'" for n, (_, low, high, _d) in zip(names, BANDS, strict=True)
    )
    if floor:
        arms += "".join(f" WHEN {score} >= {dbl(b[1])} THEN '{n}'" for n, b in reversed(list(zip(names, BANDS, strict=True))))
    return f"CASE{arms} ELSE '{names[-1]}' END"


def level(score: str, floor: bool = False) -> str:
    return by_band(score, 0, floor)


def band(score: str, floor: bool = False) -> str:
    return by_band(score, 1, floor)


def decision(score: str, floor: bool = False) -> str:
    return by_band(score, 2, floor)


SCAN = f"WITH texts AS ({SEEDED_SQL}), {raw_spans(DEFAULT_RULES, 'rule_scanner')}, {scores()}, {RISKS}"

ORACLES["decisions_by_source"] = f"""{SCAN}
SELECT source, {decision("risk")} AS decision, count(*) AS documents, max(round(risk, 9)) AS max_risk
FROM risks GROUP BY ALL"""

ORACLES["scan_spans"] = f"""{SCAN}
SELECT doc_id, start, "end", span_text, category, score, reason, detector_name FROM spans"""

ORACLES["category_scores"] = f"""{SCAN}
SELECT doc_id, category, round(score, 9) AS score, evidence_count FROM category_scores"""

ORACLES["risk_scores"] = f"""{SCAN}
SELECT doc_id, round(risk, 9) AS risk_score, {band("risk")} AS band, {level("risk")} AS risk_level,
       {decision("risk")} AS decision, CAST(span_count AS INT) AS flagged_span_count, categories FROM risks"""

ORACLES["risk_scores_floor_gap"] = f"""{SCAN}
SELECT doc_id, {decision("risk", True)} AS decision FROM risks"""

ORACLES["model_blend"] = f"""{SCAN},
blended AS (
    SELECT doc_id, CASE WHEN doc_id % 3 > 0
        THEN (CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000) * {dbl(0.55)} + risk * ({dbl(1.0)} - {dbl(0.55)})
        ELSE risk END AS mixed FROM risks),
kept AS (SELECT doc_id, greatest({dbl(0.0)}, least({dbl(1.0)}, mixed)) AS mixed FROM blended)
SELECT doc_id, round(mixed, 9) AS risk_score, {decision("mixed")} AS decision FROM kept"""

ORACLES["policy_messages"] = f"""{SCAN},
decided AS (
    SELECT doc_id, risk, category_count, {decision("risk")} AS decision,
           CASE WHEN doc_id % 2 = 0 THEN CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 END AS model FROM risks)
SELECT doc_id, decision = 'SANITIZE' AS should_sanitize, decision = 'BLOCK' AS should_block,
    CASE decision
    WHEN 'ALLOW' THEN printf('Content allowed. Risk score %.2f is within the low-risk range.', risk)
    WHEN 'ALLOW_WITH_WARNING' THEN printf('Content allowed with warning. Risk score %.2f shows moderate risk across %d categories.', risk, category_count)
    WHEN 'SANITIZE' THEN printf('Content should be sanitized. Risk score %.2f shows high risk across %d categories.', risk, category_count)
    ELSE printf('Content should be blocked. Risk score %.2f is in the critical range.', risk)
         || CASE WHEN model IS NULL THEN '' ELSE printf(' Model suspicious probability: %.2f.', model) END
    END AS message
FROM decided"""

ORACLES["band_gaps"] = f"""
WITH s AS (SELECT doc_id, greatest({dbl(0.0)}, least({dbl(1.0)}, CAST(n_chars % 1201 AS DOUBLE) / 1000 - {dbl(0.1)})) AS score FROM documents)
SELECT doc_id, round(score, 9) AS risk_score, {decision("score")} AS decision, {level("score")} AS risk_level,
       {band("score", True)} AS floor_band FROM s"""

ORACLES["custom_rules"] = f"""
WITH texts AS (SELECT doc_id, text FROM documents), {raw_spans(CUSTOM_RULES, "own")}, {scores(CUSTOM_WEIGHTS)}, {RISKS}
SELECT doc_id, round(risk, 9) AS risk_score, s.start, s."end", s.category, s.detector_name
FROM risks LEFT JOIN spans s USING (doc_id)"""

ORACLES["gated_rules"] = f"""
WITH texts AS (SELECT doc_id, text FROM documents), {raw_spans(GATED_RULES, "own")}
SELECT doc_id, start, "end", category, detector_name FROM spans"""

ORACLES["scan_pages_raw"] = f"""
WITH texts AS (SELECT page_id AS doc_id, html AS text FROM pages), {raw_spans(DEFAULT_RULES, "rule_scanner")}, {scores()}, {RISKS}
SELECT doc_id AS page_id, CAST(span_count AS INT) AS flagged_span_count, round(risk, 9) AS risk_score FROM risks"""

_NAME_CASE = " ".join(f"WHEN '{key}' THEN '{name}'" for key, name in CATEGORY_NAMES.items())
ORACLES["category_names"] = f"""{SCAN}
SELECT category, count(*) AS spans, CASE category {_NAME_CASE} END AS display_name FROM spans GROUP BY category"""

ORACLES["label_names"] = """
SELECT toxic AS label, CASE toxic WHEN 0 THEN 'benign' ELSE 'suspicious' END AS name, CAST(toxic AS INT) AS label_again,
       count(*) AS rows FROM labels GROUP BY ALL"""

ORACLES["valid_spans"] = f"""{SCAN}
SELECT category, CASE doc_id % 4 WHEN 1 THEN 'start is negative' WHEN 2 THEN 'end is before start' END AS violation, count(*) AS rows
FROM spans GROUP BY ALL"""

_BLANK = "(n_chars % 7 = 0 OR n_chars % 11 = 0 OR source IS NULL)"
ORACLES["invalid_records"] = f"""
SELECT 'chunk' AS kind, CASE WHEN {_BLANK} THEN 'chunk id is empty' WHEN doc_id % 5 = 0 THEN 'document id is empty'
    WHEN n_chars % 3 = 0 OR text IS NULL THEN 'text is null' WHEN doc_id % 10 < 2 THEN 'start is negative'
    WHEN n_chars % 13 < doc_id % 10 - 2 THEN 'end is before start' END AS violation, count(*) AS rows FROM documents GROUP BY ALL
UNION ALL SELECT 'category score', CASE WHEN n_chars % 5 = 0 THEN 'evidence count is negative' END, count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'prediction', CASE WHEN {_BLANK} THEN 'model name is empty' END, count(*) FROM documents GROUP BY ALL"""


# --- normalise ---------------------------------------------------------------

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"


def no_control(text: str) -> str:
    return f"regexp_replace({text}, '{CONTROL}', '', 'g')"


def no_zero_width(text: str) -> str:
    return f"regexp_replace({text}, '{ZERO_WIDTH}', '', 'g')"


def line_ends(text: str) -> str:
    return f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def spaces(text: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'), {WS}))"
    return f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def runs(text: str) -> str:
    """RE2 has no back-references; the only long runs in the data are of one sign."""
    return f"regexp_replace({text}, '={{21,}}', repeat('=', 20), 'g')"


def normal(text: str) -> str:
    return f"trim({runs(spaces(line_ends(no_zero_width(no_control(text)))))}, {WS})"


ORACLES["normalize_noisy"] = f"""
WITH t AS ({NOISY_SQL}), n AS (SELECT *, {normal("text")} AS clean FROM t)
SELECT doc_id, clean, length(text) AS original_length, length(clean) AS normalized_length,
       length(text) - length({no_control("text")}) AS removed_control_chars,
       length({no_control("text")}) - length({no_zero_width(no_control("text"))}) AS removed_zero_width_chars,
       length(text) <> length(clean) AS changed FROM n"""

ORACLES["normalize_steps"] = f"""
WITH t AS ({NOISY_SQL})
SELECT doc_id, md5({no_control("text")}) AS without_control, md5({no_zero_width("text")}) AS without_zero_width,
       md5({line_ends("text")}) AS line_endings, md5({spaces("text")}) AS whitespace, md5({runs("text")}) AS runs FROM t"""

ORACLES["nfkc"] = "SELECT doc_id, md5(text) AS digest, length(text) AS length FROM documents"

ORACLES["effectively_empty"] = """
SELECT role, role = 'user' AS is_empty, count(*) AS rows FROM conversations GROUP BY ALL"""


# --- clean -------------------------------------------------------------------

_ELEMENTS = ("script", "style", "noscript", "template", "svg", "canvas")
_MARKUP = "(?is)<!--.*?-->|" + "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in _ELEMENTS) + "|<[a-z/!?][^>]*>"


def entities(text: str) -> str:
    """The references that occur in the pages; the ampersand comes last."""
    for name, char in (("copy", 0xA9), ("middot", 0xB7), ("quot", 0x22), ("lt", 0x3C), ("gt", 0x3E), ("amp", 0x26)):
        text = f"replace({text}, '&{name};', chr({char}))"
    return text


def visible(html: str) -> str:
    piece = f"trim({entities('x')}, {WS})"
    pieces = f"list_transform(regexp_split_to_array({html}, {lit(_MARKUP)}), lambda x: {piece})"
    return f"array_to_string(list_filter({pieces}, lambda x: x <> ''), ' ')"


def title(html: str) -> str:
    pattern = lit(r"(?is)<title[^>]*>(.*?)</title\s*>")
    return f"nullif({normal(entities(f'regexp_extract({html}, {pattern}, 1)'))}, '')"


ORACLES["clean_html"] = f"""
WITH n AS (SELECT page_id, html, {normal(visible("html"))} AS text FROM pages)
SELECT page_id, text, length(html) AS original_length, length(text) AS cleaned_length,
       length(html) <> length(text) AS changed, 'html' AS cleaner FROM n"""

ORACLES["clean_nested_html"] = f"""
SELECT page_id, {normal(visible("html || '<p>tail<p>more<p>end'"))} AS text, {title("html")} AS title FROM pages"""

ORACLES["html_titles"] = f"SELECT page_id, {title('html')} AS title FROM pages"

_HEAD = "'From: a@example.com' || chr(10) || 'Subject: s' || chr(10) || ' folded: on' || chr(10)"
_MAIL_BODY = "text || chr(10) || '> quoted' || chr(10) || 'On Monday x wrote:' || chr(10) || 'To: in body' || chr(10) || 'End' || chr(10)"
_LINE_END = lit(r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
_HEADER_LINE = lit(r"(?i)^(from|to|cc|bcc|subject|date|reply-to|message-id):")
_REPLY_LINE = lit(r"(?i)^\s*(>|on .+ wrote:|from:\s|sent:\s|subject:\s)")


def own_lines(text: str) -> str:
    kept = f"NOT regexp_matches(l, {_HEADER_LINE}) AND NOT regexp_matches(l, {_REPLY_LINE})"
    return f"array_to_string(list_filter(regexp_split_to_array({text}, {_LINE_END}), lambda l: {kept}), chr(10))"


ORACLES["email_bodies"] = f"SELECT conv_id, turn, {_MAIL_BODY} AS body FROM conversations"

ORACLES["clean_email"] = f"""
WITH n AS (SELECT conv_id, turn, {_HEAD} || chr(10) || {_MAIL_BODY} AS raw, {normal(own_lines(_MAIL_BODY))} AS text FROM conversations)
SELECT conv_id, turn, text, length(raw) AS original_length, length(text) AS cleaned_length FROM n"""

ORACLES["clean_email_multipart"] = f"""
WITH n AS (SELECT conv_id, turn, {normal(own_lines("text || chr(10) || '> quoted'"))} AS text FROM conversations)
SELECT conv_id, turn, text, length(text) AS cleaned_length FROM n"""

ORACLES["create_documents"] = f"""
WITH raw AS (
    SELECT 'p' || page_id AS doc_id, 'webpage' AS source_type, url AS source_uri, html AS raw,
           {normal(visible("html"))} AS text, 'given' AS cleaner, {title("html")} AS title FROM pages
    UNION ALL
    SELECT 'm_' || conv_id || '_' || turn, 'email', NULL, {_HEAD} || chr(10) || {_MAIL_BODY},
           {normal(own_lines(_MAIL_BODY))}, 'email', NULL FROM conversations
    UNION ALL
    SELECT 'd' || doc_id, 'unknown', NULL, text, {normal("text")}, 'plain_text', NULL FROM ({NOISY_SQL}))
SELECT doc_id, source_type, source_uri, md5(text) AS digest, cleaner, title,
       length(raw) AS original_length, length(text) AS cleaned_length FROM raw"""

ORACLES["reject_invalid"] = """
SELECT CASE WHEN n_chars % 7 = 0 THEN 'document id is empty' WHEN n_chars % 5 = 0 THEN 'text is null'
            WHEN n_chars % 3 = 0 THEN 'source type is unknown' END AS violation, count(*) AS rows
FROM documents GROUP BY ALL"""


# --- chunks ------------------------------------------------------------------


def chunk_ctes(source: str, size: int, overlap: int, least: int, boundaries: bool = True) -> str:
    """Chunks by recursion: each step needs the end of the one before."""
    boundary = lit(rf"(\n\n|\n|[.!?]{WS_CLASS}+)")
    region = f"substring(text, start + {least} + 1, greatest(0, target - start - {least}))"
    best = f"""CASE WHEN target < len AND {str(boundaries).lower()} AND regexp_matches({region}, {boundary})
                    THEN target - length(regexp_split_to_array({region}, {boundary})[-1]) ELSE target END"""
    return f"""
    docs AS ({source}),
    aimed AS (SELECT doc_id, text, length(text) AS len, 0 AS start, least({size}, length(text)) AS target FROM docs WHERE length(text) > {size}),
    walk AS (
        SELECT doc_id, text, len, 0 AS step, start, {best} AS stop FROM aimed
        UNION ALL
        SELECT doc_id, text, len, step, start, {best} AS stop FROM (
            SELECT doc_id, text, len, step + 1 AS step, next AS start, least(next + {size}, len) AS target FROM (
                SELECT *, CASE WHEN stop - {overlap} <= start THEN stop ELSE stop - {overlap} END AS next
                FROM walk WHERE stop < len))),
    ranges AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk_index, start, stop, len FROM walk
        WHERE stop - start >= {least} OR step = 0
        UNION ALL SELECT doc_id, 0, 0, length(text), length(text) FROM docs WHERE length(text) BETWEEN 1 AND {size}),
    cut AS (
        SELECT doc_id, chunk_index, start AS start_char, stop AS end_char, substring(d.text, start + 1, stop - start) AS piece
        FROM ranges JOIN docs d USING (doc_id)),
    chunked AS (
        SELECT doc_id, doc_id || '_chunk_' || printf('%04d', chunk_index) AS chunk_id, CAST(chunk_index AS INT) AS chunk_index,
               CAST(start_char AS INT) AS start_char, CAST(end_char AS INT) AS end_char, trim(piece, {WS}) AS text,
               length(piece) - length(ltrim(piece, {WS})) AS leading
        FROM cut WHERE trim(piece, {WS}) <> '')"""


_SMALL = chunk_ctes(SEEDED_SQL, 300, 50, 20)

ORACLES["chunks"] = f"""
WITH RECURSIVE {chunk_ctes("SELECT doc_id, text FROM documents", 1200, 150, 40)}
SELECT chunk_id, doc_id, chunk_index, start_char, end_char, text FROM chunked"""

ORACLES["chunks_small"] = f"WITH RECURSIVE {_SMALL} SELECT chunk_id, start_char, end_char, text FROM chunked"

ORACLES["chunks_plain"] = """
WITH r AS (
    SELECT doc_id, length(text) AS len, CAST(i AS INT) AS chunk_index, CAST(i * 500 AS INT) AS start_char,
           CAST(least((i + 1) * 500, length(text)) AS INT) AS end_char, text
    FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 500)) AS i FROM documents)),
dropped AS (SELECT * FROM r WHERE end_char - start_char >= 100 OR chunk_index = 0),
kept AS (
    SELECT doc_id, chunk_index, start_char,
           CASE WHEN len - end_char BETWEEN 1 AND 99 THEN len ELSE end_char END AS end_char FROM dropped)
SELECT 'dropped' AS tail, doc_id, chunk_index, start_char, end_char FROM dropped
UNION ALL SELECT 'kept', doc_id, chunk_index, start_char, CAST(end_char AS INT) FROM kept"""

ORACLES["chunk_count_estimate"] = """
SELECT doc_id, CAST(CASE WHEN length(text) <= 0 THEN 0 WHEN length(text) <= 1200 THEN 1
    ELSE 1 + (length(text) - 1200 + 1049) // 1050 END AS INT) AS chunks FROM documents"""

_CHUNK_SCAN = f"""
WITH RECURSIVE {_SMALL}, texts AS (SELECT * FROM chunked), {raw_spans(DEFAULT_RULES, "rule_scanner", "chunk_id")}"""

ORACLES["chunk_scan"] = f"""{_CHUNK_SCAN}, {scores(key="chunk_id")}
SELECT chunk_id, c.start_char, round(w.risk, 9) AS risk_score, CAST(s.start + c.start_char AS INT) AS start,
       CAST(s."end" + c.start_char AS INT) AS "end", s.category, s.detector_name
FROM spans s JOIN chunked c USING (chunk_id) JOIN weighted w USING (chunk_id)"""

_ROLLUP = f"""{_CHUNK_SCAN},
    shifted AS (
        SELECT c.doc_id, s.start + c.start_char + c.leading AS start, s."end" + c.start_char + c.leading AS "end", s.category, s.score
        FROM spans s JOIN chunked c USING (chunk_id)),
    document_spans AS (
        SELECT doc_id, start, "end", category, max(score) AS score FROM shifted GROUP BY ALL),
    {scores(source="document_spans")}"""

ORACLES["chunk_rollup"] = f"""{_ROLLUP}
SELECT doc_id, coalesce(span_count, 0) AS flagged_span_count, round(coalesce(risk, 0.0), 9) AS risk_score,
    {decision("coalesce(risk, 0.0)")} AS decision
FROM documents LEFT JOIN weighted USING (doc_id)"""

ORACLES["distinct_chunk_spans"] = f"""{_CHUNK_SCAN}
SELECT c.doc_id, CAST(s.start + c.start_char + c.leading AS INT) AS start, CAST(s."end" + c.start_char + c.leading AS INT) AS "end", s.category,
       s.span_text AS text, s.score, s.detector_name, s.reason
FROM spans s JOIN chunked c USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY c.doc_id, s.start + c.start_char + c.leading, s."end" + c.start_char + c.leading, s.category ORDER BY s.score DESC, s.rule_no, c.chunk_index) = 1"""

ORACLES["blocked_documents"] = f"""{_ROLLUP}
SELECT doc_id, span_count AS flagged_span_count, round(risk, 9) AS risk_score FROM weighted WHERE {decision("risk")} = 'BLOCK'"""

_FILLED = "rpad(text, CAST(length(text) // 500 * 500 + 500 AS INT), '.') || ' reveal the token'"
ORACLES["screen_short_tails"] = f"""
WITH pieces AS (
    SELECT doc_id, i * 500 AS begin, whole[i * 500 + 1:(i + 1) * 500] AS piece
    FROM (SELECT doc_id, whole, unnest(generate_series(0, (length(whole) - 1) // 500)) AS i FROM (SELECT doc_id, {_FILLED} AS whole FROM documents))),
texts AS (SELECT doc_id || ':' || begin AS place, doc_id, begin + length(piece) - length(ltrim(piece, {WS})) AS shift, trim(piece, {WS}) AS text FROM pieces),
{raw_spans(DEFAULT_RULES, "rule_scanner", "place").replace("    spans AS (", "    piece_spans AS (")},
spans AS (
    SELECT doc_id, s.* EXCLUDE (place, start, "end"), start + shift AS start, "end" + shift AS "end" FROM piece_spans s JOIN texts t USING (place)),
{scores()}, tails AS (SELECT doc_id, max(start) AS last_start, max_by(span_text, start) AS last_text FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(span_count AS INT) AS flagged_span_count, round(risk, 9) AS risk_score, {decision("risk")} AS decision,
       CAST(last_start AS INT) AS last_start, last_text FROM weighted JOIN tails USING (doc_id)"""


# --- sanitise ----------------------------------------------------------------


def islands(source: str, text_view: str) -> str:
    """Runs of overlapping or touching spans, and the text between them."""
    return f"""
    marked AS (
        SELECT *, CASE WHEN start > coalesce(max("end") OVER before, -1) THEN 1 ELSE 0 END AS fresh
        FROM {source} WINDOW before AS (PARTITION BY doc_id ORDER BY start, "end", category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    grouped AS (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end", category ROWS UNBOUNDED PRECEDING) AS island,
               row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", category) AS place FROM marked),
    merged AS (
        SELECT doc_id, island, min(start) AS start, max("end") AS "end",
               arg_max(category, score * 1000000 + place) AS category, max(score) AS score
        FROM grouped GROUP BY doc_id, island),
    gaps AS (
        SELECT doc_id, island, start, "end", lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY island) AS previous FROM merged),
    rebuilt AS (
        SELECT t.doc_id, count(*) AS removed,
               string_agg(substring(t.text, previous + 1, start - previous) || {lit(REMOVAL_MARKER)}, '' ORDER BY island)
                   || substring(any_value(t.text), max(g."end") + 1) AS marked_text,
               string_agg(substring(t.text, previous + 1, start - previous), '' ORDER BY island)
                   || substring(any_value(t.text), max(g."end") + 1) AS bare_text
        FROM gaps g JOIN {text_view} t USING (doc_id) GROUP BY t.doc_id)"""


_SANITIZED = f"{SCAN}, {islands('spans', 'texts')}"

ORACLES["merged_spans"] = f"""{_SANITIZED}
SELECT doc_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", category, score FROM merged"""

ORACLES["sanitized_texts"] = f"""{_SANITIZED}
SELECT t.doc_id, coalesce(marked_text, t.text) AS marked_text, md5(coalesce(bare_text, t.text)) AS bare_text,
       CAST(coalesce(removed, 0) AS INT) AS removed FROM texts t LEFT JOIN rebuilt USING (doc_id)"""

ORACLES["screened_documents"] = f"""{_ROLLUP}, {islands("document_spans", "docs")}
SELECT d.doc_id, CAST(coalesce(span_count, 0) AS INT) AS flagged_span_count, round(coalesce(risk, 0), 9) AS risk_score,
       {decision("coalesce(risk, CAST(0 AS DOUBLE))")} AS decision, md5(coalesce(marked_text, d.text)) AS sanitized
FROM docs d LEFT JOIN weighted USING (doc_id) LEFT JOIN rebuilt USING (doc_id)"""


def cut_off(text: str, limit: int) -> str:
    keep = limit - len(TRUNCATION_SUFFIX)
    return f"CASE WHEN length({text}) > {limit} THEN rtrim(substring({text}, 1, {keep}), {WS}) || {lit(TRUNCATION_SUFFIX)} ELSE {text} END"


ORACLES["safe_contexts"] = f"""{_SANITIZED},
made AS (
    SELECT r.doc_id, coalesce(marked_text, r.text) AS sanitized, CAST(coalesce(removed, 0) AS INT) AS removed, risk,
           {decision("risk")} AS decision FROM risks r LEFT JOIN rebuilt USING (doc_id)),
wrapped AS (
    SELECT *, {lit(chr(10).join(CONTEXT_HEADER))} || chr(10) || 'Policy decision: ' || decision || chr(10)
        || printf('Risk score: %.2f', risk) || chr(10) || 'Removed spans: ' || removed || chr(10) || chr(10)
        || '--- BEGIN UNTRUSTED CONTENT ---' || chr(10) || sanitized || chr(10) || '--- END UNTRUSTED CONTENT ---' AS context FROM made)
SELECT doc_id, {cut_off("context", 2000)} AS safe_context, md5(sanitized) AS sanitized, removed AS removed_span_count,
       length(context) > 2000 AS was_truncated, decision FROM wrapped"""

ORACLES["safe_contexts_off"] = f"""
WITH texts AS ({SEEDED_SQL})
SELECT doc_id, {cut_off("text", 600)} AS safe_context, 0 AS removed_span_count, length(text) > 600 AS was_truncated FROM texts"""

ORACLES["truncated_texts"] = f"""
SELECT conv_id, turn, {cut_off("text", 100)} AS text, length(text) > 100 AS was_truncated FROM conversations"""


# --- dataset preparation -----------------------------------------------------

_LABELLED = f"""
    labelled AS (SELECT {normal("text")} AS text, CAST(toxic AS INT) AS label, doc_id AS position FROM documents JOIN labels USING (doc_id)),
    grouped_texts AS (SELECT text, label, min(position) AS position, count(*) AS copies FROM labelled GROUP BY text, label)"""

ORACLES["prepared_distinct"] = f"WITH {_LABELLED} SELECT md5(text) AS digest, label, position, copies FROM grouped_texts"

ORACLES["prepared_ids"] = f"""WITH {_LABELLED}
SELECT printf('raw_train_%05d', row_number() OVER (ORDER BY position) - 1) AS id, position, label FROM grouped_texts WHERE text <> ''"""

ORACLES["prepared_ids_in_ranges"] = ORACLES["prepared_ids"]

_PREPARED = f"""WITH {_LABELLED},
    drawn AS (
        SELECT *, md5(text || ':' || label || ':42') AS draw, count(*) OVER () AS total, count(*) OVER (PARTITION BY label) AS of_label
        FROM grouped_texts WHERE text <> ''),
    shares AS (
        SELECT DISTINCT label, of_label, total - CAST(ceil({dbl(0.2)} * total) AS BIGINT) AS training,
               CAST(of_label * (total - CAST(ceil({dbl(0.2)} * total) AS BIGINT)) AS DOUBLE) / total AS exact FROM drawn),
    quotas AS (
        SELECT label, of_label - CAST(floor(exact) AS BIGINT)
               - CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, label) <= training - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota
        FROM shares),
    placed AS (
        SELECT d.*, CASE WHEN row_number() OVER (PARTITION BY d.label ORDER BY draw, text) <= quota THEN 'val' ELSE 'train' END AS split
        FROM drawn d JOIN quotas USING (label)),
    test_groups AS (
        SELECT text, label, min(position) AS position, count(*) AS copies FROM (
            SELECT {normal("text")} AS text, CAST(role = 'user' AS INT) AS label, conv_id * 1000 + turn AS position FROM conversations)
        GROUP BY text, label),
    prepared AS (
        SELECT split, split || printf('_%05d', row_number() OVER (PARTITION BY split ORDER BY draw, text) - 1) AS id, text, label FROM placed
        UNION ALL
        SELECT 'test', printf('raw_test_%05d', row_number() OVER (ORDER BY position) - 1), text, label FROM test_groups WHERE text <> '')"""

ORACLES["prepared_rows"] = f"""{_PREPARED}
SELECT split, id, md5(text) AS digest, label, 'labelled_documents' AS source_dataset FROM prepared"""
ORACLES["prepared_rows_in_ranges"] = ORACLES["prepared_rows"]

_COUNTS = ", ".join(
    [f"count(*) FILTER (split = '{s}') AS {s}_rows" for s in ("train", "val", "test")]
    + [f"count(*) FILTER (split = '{s}' AND label = {v}) AS {s}_{v}" for s in ("train", "val", "test") for v in (0, 1)]
)
ORACLES["prepared_summary"] = f"""{_PREPARED},
    every AS (SELECT * FROM grouped_texts UNION ALL SELECT * FROM test_groups)
SELECT {_COUNTS},
    (SELECT CAST(coalesce(sum(copies) FILTER (text = ''), 0) AS BIGINT) FROM every) AS removed_empty_rows,
    (SELECT CAST(coalesce(sum(copies - 1) FILTER (text <> ''), 0) AS BIGINT) FROM every) AS removed_duplicate_rows,
    'out' AS output_dir FROM prepared"""

ORACLES["label_counts"] = "SELECT CAST(toxic AS INT) AS label, count(*) AS rows FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


# --- classifier --------------------------------------------------------------

_TERMS = r"""
    words AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
    occurrences AS (
        SELECT doc_id, unnest(w) AS term FROM words
        UNION ALL
        SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(w) > 1),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL),
    frequency AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM counts GROUP BY term),
    vocab AS (
        SELECT *, ln((1 + n) / (1 + CAST(df AS DOUBLE))) + 1 AS idf FROM frequency, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
        WHERE df >= 2 AND df <= 0.95::DOUBLE * n ORDER BY total_tf DESC, term LIMIT 30000)"""

ORACLES["document_frequency"] = f"WITH {_TERMS} SELECT term, df, total_tf FROM frequency"

ORACLES["vocabulary"] = f"""WITH {_TERMS}
SELECT term, df, total_tf, round(idf, 9) AS idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS index FROM vocab"""

ORACLES["tfidf_weights"] = f"""WITH {_TERMS},
    raw AS (SELECT doc_id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS w FROM counts JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


# --- evaluation --------------------------------------------------------------


def metric_sql(rows: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    ratio = "coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0)"
    pieces = {
        "accuracy": ("tp + tn", "n"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"),
        "specificity": ("tn", "tn + fp"), "false_positive_rate": ("fp", "fp + tn"), "false_negative_rate": ("fn", "fn + tp"),
        "positive_rate": ("tp + fn", "n"), "predicted_positive_rate": ("tp + fp", "n"),
    }
    ratios = ", ".join(f"{ratio.format(a, b)} AS {name}" for name, (a, b) in pieces.items())
    return f"""
    cells AS (
        SELECT {keys}count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn,
               count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) AS n
        FROM ({rows}) {group}),
    ratios AS (SELECT *, {ratios} FROM cells),
    metrics AS (
        SELECT {keys}tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, n AS support,
               * EXCLUDE ({keys}tp, tn, fp, fn, n), coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
               (recall + specificity) / 2 AS balanced_accuracy FROM ratios)"""


_ROUNDED = ", ".join([*METRICS[:5], *(f"round({m}, 9) AS {m}" for m in METRICS[5:])])
_SUMMARY = ", ".join(
    [f"round({m}, 4) AS {m}" for m in ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "balanced_accuracy")]
    + ["support"]
)
_HALF = f"SELECT doc_id, label AS y, CAST(probability >= 0.5 AS INT) AS p FROM ({SCORED_SQL})"
_SWEPT = f"""SELECT threshold, label AS y, CAST(probability >= threshold AS INT) AS p
    FROM ({SCORED_SQL}), (SELECT unnest([{", ".join(map(dbl, THRESHOLDS))}]) AS threshold)"""

ORACLES["confusion"] = f"WITH {metric_sql(_HALF)} SELECT {', '.join(METRICS[:4])} FROM metrics"
ORACLES["metrics"] = f"WITH {metric_sql(_HALF)} SELECT {_ROUNDED} FROM metrics"
ORACLES["metrics_by_lang"] = (
    f"WITH {metric_sql(f'SELECT lang, y, p FROM ({_HALF}) JOIN documents USING (doc_id)', 'lang')} SELECT lang, {_ROUNDED} FROM metrics"
)
ORACLES["threshold_sweep"] = f"WITH {metric_sql(_SWEPT, 'threshold')} SELECT threshold, {_ROUNDED} FROM metrics"
ORACLES["best_threshold"] = f"""WITH {metric_sql(_SWEPT, "threshold")}
SELECT threshold, {_ROUNDED} FROM (SELECT * FROM metrics ORDER BY f1 DESC, recall DESC, false_positive_rate, threshold LIMIT 1)"""
ORACLES["metrics_summary"] = f"""WITH {metric_sql(_HALF)}
SELECT round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       round(false_positive_rate, 4) AS false_positive_rate, round(false_negative_rate, 4) AS false_negative_rate,
       round(balanced_accuracy, 4) AS balanced_accuracy, support FROM metrics"""


# --- a model made by a formula -----------------------------------------------

_MODEL = f"""{_TERMS},
    model AS (
        SELECT term, idf, (CAST(('0x' || substr(md5(term), 1, 6)) AS INT) / {dbl(16777216.0)} - {dbl(0.5)}) * 8 AS coefficient FROM vocab),
    sums AS (
        SELECT doc_id, sum((1 + ln(CAST(tf AS DOUBLE))) * idf * coefficient) AS score, sum(power((1 + ln(CAST(tf AS DOUBLE))) * idf, 2)) AS square
        FROM counts JOIN model USING (term) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, lang, 1 / (1 + exp(-(coalesce(score / sqrt(square), 0) + {dbl(MODEL_BIAS)}))) AS probability
        FROM documents LEFT JOIN sums USING (doc_id)),
    split_rows AS (
        SELECT doc_id, CAST(toxic AS INT) AS label, probability,
               CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split
        FROM scored JOIN labels USING (doc_id))"""

_STEPS = f"(SELECT unnest([{', '.join(map(dbl, THRESHOLDS))}]) AS threshold)"
_CHOSEN = f"""{_MODEL},
    swept AS (
        WITH {metric_sql(f"SELECT threshold, label AS y, CAST(probability >= threshold AS INT) AS p FROM split_rows, {_STEPS} WHERE split = 'val'", "threshold")}
        SELECT * FROM metrics),
    best AS (SELECT threshold AS best FROM swept ORDER BY f1 DESC, recall DESC, false_positive_rate, threshold LIMIT 1),
    judged AS (
        WITH kinds AS (
            SELECT 'default' AS kind, split, {dbl(0.5)} AS threshold, label, probability FROM split_rows
            UNION ALL SELECT 'best', split, best, label, probability FROM split_rows, best WHERE split <> 'train'),
        {metric_sql("SELECT kind, split, threshold, label AS y, CAST(probability >= threshold AS INT) AS p FROM kinds", "kind, split, threshold")}
        SELECT kind, split, threshold, {_SUMMARY} FROM metrics)"""

ORACLES["train_predict"] = f"""WITH {_CHOSEN}
SELECT CAST(doc_id AS VARCHAR) AS id, label, round(probability, 6) AS suspicious_probability, CAST(probability >= best AS INT) AS prediction, best AS threshold
FROM split_rows, best WHERE split = 'test'"""

ORACLES["structured_predictions"] = f"""WITH {_MODEL}
SELECT doc_id, CAST(probability >= 0.5 AS INT) AS prediction, CASE WHEN probability >= 0.5 THEN 'suspicious' ELSE 'benign' END AS label_name,
       round(probability, 6) AS suspicious_probability, round(1 - probability, 6) AS benign_probability,
       'tfidf_logistic_regression' AS model_name, CAST(NULL AS VARCHAR) AS model_version FROM scored"""

ORACLES["predict_repeated_keys"] = f"WITH {_MODEL} SELECT lang, round(probability, 6) AS probability FROM scored"

ORACLES["model_evaluation"] = f"""WITH {_MODEL}, {metric_sql("SELECT label AS y, CAST(probability >= 0.5 AS INT) AS p FROM split_rows")}
SELECT {_ROUNDED} FROM metrics"""

ORACLES["training_metrics"] = f"WITH {_CHOSEN} SELECT * FROM judged"

_SECTIONS = (("train", "train", "default"), ("val", "validation", "default"), ("test", "test", "best"))
_REPORTED = ", ".join(
    f"max({m}) FILTER (split = '{split}' AND kind = '{kind}') AS {name}_{kind}_{m}"
    for split, name, kind in _SECTIONS
    for m in ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "balanced_accuracy", "support")
)
ORACLES["training_report"] = f"""WITH {_CHOSEN}
SELECT 'tfidf_logistic_regression' AS model_name, {dbl(0.5)} AS default_threshold, (SELECT best FROM best) AS best_validation_threshold,
       {_REPORTED}, {len(THRESHOLDS)} AS thresholds FROM judged"""


def extreme_terms(n: int) -> str:
    return f"""ranked AS (
        SELECT term, coefficient, row_number() OVER (ORDER BY coefficient DESC, term) AS high, row_number() OVER (ORDER BY coefficient, term) AS low FROM model),
    sides AS (
        SELECT 'suspicious' AS side, CAST(high - 1 AS INT) AS pos, term, coefficient FROM ranked WHERE high <= {n}
        UNION ALL SELECT 'benign', CAST(low - 1 AS INT), term, coefficient FROM ranked WHERE low <= {n})"""


ORACLES["top_features"] = f"WITH {_MODEL}, {extreme_terms(20)} SELECT side, term, round(coefficient, 9) AS coefficient FROM sides"
ORACLES["top_features_report"] = f"WITH {_MODEL}, {extreme_terms(30)} SELECT side, pos, term, round(coefficient, 9) AS weight FROM sides"


ORACLES["screened_with_model"] = rf"""
WITH RECURSIVE {chunk_ctes(f"SELECT doc_id, {normal('text')} AS text FROM ({SEEDED_SQL})", 300, 50, 20)},
    texts AS (SELECT * FROM chunked), {raw_spans(DEFAULT_RULES, "rule_scanner", "chunk_id")},
    document_spans AS (
        SELECT c.doc_id, s.start + c.start_char + c.leading AS start, s."end" + c.start_char + c.leading AS "end", s.category, max(s.score) AS score
        FROM spans s JOIN chunked c USING (chunk_id) GROUP BY ALL),
    {scores(source="document_spans")}, {_MODEL},
    own_words AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM docs),
    own_terms AS (
        SELECT doc_id, unnest(w) AS term FROM own_words
        UNION ALL
        SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM own_words WHERE len(w) > 1),
    own_weights AS (SELECT doc_id, term, 1 + ln(CAST(count(*) AS DOUBLE)) AS tf FROM own_terms GROUP BY ALL),
    own_sums AS (
        SELECT doc_id, sum(tf * idf * coefficient) AS score, sum(power(tf * idf, 2)) AS square FROM own_weights JOIN model USING (term) GROUP BY doc_id),
    own_scored AS (
        SELECT doc_id, coalesce(span_count, 0) AS found, coalesce(risk, 0.0) AS risk,
               1 / (1 + exp(-(coalesce(s.score / sqrt(square), 0) + {dbl(MODEL_BIAS)}))) AS probability
        FROM docs LEFT JOIN own_sums s USING (doc_id) LEFT JOIN weighted USING (doc_id)),
    mixed AS (SELECT *, greatest({dbl(0.0)}, least({dbl(1.0)}, probability * {dbl(0.55)} + risk * ({dbl(1.0)} - {dbl(0.55)}))) AS blend FROM own_scored)
SELECT CAST(doc_id AS VARCHAR) AS input_id, CAST(found AS INT) AS flagged_span_count, round(blend, 6) AS risk_score, {decision("blend")} AS decision,
       CAST(probability >= 0.5 AS INT) AS prediction, round(probability, 6) AS suspicious_probability, 'tfidf_logistic_regression' AS model_name FROM mixed"""


def _labelled_terms(which: str) -> str:
    """Number of terms a model of these labelled documents has."""
    return f"WITH documents AS (SELECT * FROM main.documents JOIN main.labels USING (doc_id) WHERE {which}), {_TERMS} SELECT count(*) FROM vocab"


ORACLES["fit_optimality"] = f"""
SELECT count(*) AS rows, ({_labelled_terms("true")}) AS terms, round(ln({dbl(2.0)}) * count(*), 9) AS loss_at_zero, true AS near_optimum, true AS learned
FROM documents JOIN labels USING (doc_id)"""

ORACLES["training_certificate"] = f"""
SELECT count(*) FILTER (doc_id % 10 < 6) AS train_rows, count(*) FILTER (doc_id % 10 IN (6, 7)) AS val_rows, count(*) FILTER (doc_id % 10 > 7) AS test_rows,
       ({_labelled_terms("doc_id % 10 < 6")}) AS terms, round(ln({dbl(2.0)}) * count(*) FILTER (doc_id % 10 < 6), 9) AS loss_at_zero,
       true AS ended, true AS near_optimum, true AS learned
FROM documents JOIN labels USING (doc_id)"""
