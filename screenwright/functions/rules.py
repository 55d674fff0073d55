"""Rule scan: every match of every rule with its character offsets."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.constants import DEFAULT_RULES, Rule
from screenwright.functions.core import SPACE, WORD, let, note, noted, paged, strip

SPAN_TYPE = (
    "struct<start:int,end:int,text:string,category:string,score:double,reason:string,detector_name:string>"
)
NO_SPANS = f"array<{SPAN_TYPE}>"

# Ignore case (also beyond ASCII), let ^ and $ work per line, let . match line
# ends, and take only \n as a line end.
FLAGS = "(?imsdu)"

# One list of words, or two lists with a gap between them.
_WORD_LISTS = re.compile(r"\\b\(([\w |]+)\)\\b(?:\.\{0,\d+\}\\b\(([\w |]+)\)\\b)?")

# Letters that match an ASCII letter when case is ignored, and that letter.
_FOLDED = ("".join(map(chr, (0x130, 0x131, 0x17F, 0x212A))), "iisk")


_RULE = (
    "struct<number:int,category:string,score:double,reason:string,detector_name:string,pattern:string,"
    "lists:array<array<array<string>>>,contains:string,factors:array<string>>"
)
_RAW = "struct<start:int,end:int,category:string,rank:double,rule:int,text:string>"


def check_rules(rules: Sequence[Rule] | None) -> tuple[Rule, ...]:
    """The rule pack to use; an empty one means the default pack."""
    pack = tuple(rules or DEFAULT_RULES)
    for rule in pack:
        if not rule.category.strip():
            raise ValueError(f"Rule {rule.name} needs a category.")
        try:
            compiled = re.compile(rule.pattern, re.IGNORECASE | re.MULTILINE | re.DOTALL)
        except re.error as error:
            raise ValueError(f"Rule {rule.name} has an invalid pattern: {error}") from error
        if any(match.group() == "" for probe in ("", "a", " ", "a b\n<") for match in compiled.finditer(probe)):
            raise ValueError(f"Rule {rule.name} can match an empty string.")
        if re.search(r"\(\?P[=<]|\(\?\(|\\Z|\\B|\(\?[aLx-]", rule.pattern):
            raise ValueError(f"Rule {rule.name} uses syntax outside the shared regex subset.")
    return pack


def spark_pattern(pattern: str) -> str:
    """The rule's pattern with word edges and classes as Python understands them."""
    if _WORD_LISTS.fullmatch(pattern):
        edged = pattern.replace(r"\b(", f"(?<!{WORD})(").replace(r")\b", f")(?!{WORD})")
    else:
        edged = pattern.replace(r"\b", f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))")
    return FLAGS + _classes(edged)


def _classes(pattern: str) -> str:
    """Character classes as Python understands them."""
    classes = {r"\s": SPACE, r"\S": "[^" + SPACE[1:], r"\w": WORD, r"\W": r"[^\p{L}\p{N}_]", r"\d": r"\p{Nd}"}
    return reduce(lambda text, pair: text.replace(*pair), classes.items(), pattern)


def _word_lists(rule: Rule) -> list[list[str]] | None:
    """The lists a rule needs a term of each from, if it is made of word lists."""
    shape = _WORD_LISTS.fullmatch(rule.pattern)
    return shape and [group.lower().split("|") for group in shape.groups() if group]


def _key_words(rules: Sequence[Rule]) -> list[str]:
    terms = {term for rule in rules for words in _word_lists(rule) or () for term in words}
    return sorted({word for term in terms for word in term.split()})


def _words_present(text: Column, words: Sequence[str]) -> Column:
    """Which of ``words`` occur in the text, found in one pass.

    Edges are looser than those of the rules, so this may report too much but
    never too little. Alternatives are grouped by first letter for speed.
    """
    by_letter = defaultdict(list)
    for word in words:
        by_letter[word[0]].append(word[1:])
    branches = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    found = F.regexp_extract_all(
        text, F.lit(f"(?iu)(?<![A-Za-z0-9_])(?:{branches})(?![A-Za-z0-9_])"), F.lit(0)
    )
    return F.array_distinct(F.transform(found, lambda word: F.lower(F.translate(word, *_FOLDED))))


def required_factors(pattern: str) -> list[str]:
    """Lower-case ASCII strings of which every match of a pattern holds at least one; none if there are no such strings.

    A sequence needs each of its parts, so its longest literal, or a part that needs one, will do. Alternatives need
    factors each. What may be absent, and classes of characters, need nothing.
    """

    def weight(factors: list[str]) -> int:
        return min(map(len, factors), default=0)

    def of_sequence(items) -> list[str]:
        found: list[list[str]] = []
        run = ""
        todo = list(items)[::-1]
        while todo:
            kind, value = todo.pop()
            name = str(kind)
            if name == "LITERAL" and 32 < value < 127 or (name, value) == ("LITERAL", 32):
                run += chr(value).lower()
                continue
            if name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            if name == "SUBPATTERN":
                todo += list(value[-1])[::-1]
                continue
            found.append([run] if run else [])
            run = ""
            if name == "BRANCH":
                arms = [of_sequence(arm) for arm in value[1]]
                found.append([f for arm in arms for f in arm] if all(arms) else [])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                found.append(of_sequence(value[2]))
            elif name == "ATOMIC_GROUP":
                found.append(of_sequence(value))
        found.append([run] if run else [])
        return max(found, key=weight)

    # not of texts in free spacing, which rules may not use
    return sorted(set(of_sequence(re._parser.parse(pattern, re.IGNORECASE | re.MULTILINE | re.DOTALL))))


def _factors(rule: Rule) -> list[str]:
    """Factors of rules that are neither word lists nor have a literal form of their own."""
    return [] if _word_lists(rule) or rule.contains or rule.linear else required_factors(rule.pattern)


def _factors_present(text: Column, factors: Sequence[str]) -> Column:
    """The longest factor at each place of the text where one begins, found in one pass.

    A factor that is not reported begins one that is. Letters that match an ASCII letter when case is ignored are
    reported as that letter.
    """
    longest = sorted(factors, key=lambda f: (-len(f), f))
    found = F.regexp_extract_all(text, F.lit(f"(?iu)(?=({'|'.join(map(re.escape, longest))}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda f: F.lower(F.translate(f, *_FOLDED))))


def _rule_table(rules: Sequence[Rule], detector: str) -> Column:
    """The rule pack as one constant array, so that its size does not grow the plan."""
    rows = [
        {
            "number": number,
            "category": rule.category,
            "score": min(1.0, max(0.0, float(rule.score))),
            "reason": rule.reason,
            "detector_name": f"{detector}:{rule.name}",
            "pattern": spark_pattern(rule.linear or rule.pattern),
            "lists": [[term.split() for term in terms] for terms in _word_lists(rule) or ()],
            "contains": rule.contains,
            "factors": _factors(rule),
        }
        for number, rule in enumerate(rules, start=1)
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE}>")


def _may_match(rule: Column, text: Column, present: Column, beginning: Column) -> Column:
    """False only where the rule surely has no match: a word of each list, or one of its factors, must be there."""

    def has_term(terms: Column) -> Column:
        return F.exists(terms, lambda words: F.forall(words, lambda word: F.array_contains(present, word)))

    literal = F.coalesce(F.contains(text, rule["contains"]), F.lit(True))
    held = F.exists(rule["factors"], lambda f: F.exists(beginning, lambda longest: F.startswith(longest, f)))
    return literal & F.forall(rule["lists"], has_term) & ((F.size(rule["factors"]) == 0) | held)


def _matches(rule: Column, text: Column) -> Column:
    """Raw matches of one rule.

    Spark has no match positions: a match starts after the pieces and matches
    before it, where the pieces come from splitting by the same pattern.
    """

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, rule["pattern"], -1), 1, F.size(found))
        lengths = F.zip_with(
            found, gaps, lambda m, gap: F.struct(F.length(m).alias("hit"), F.length(gap).alias("gap"))
        )
        walked = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("starts")),
            lambda state, step: F.struct(
                (state["at"] + step["gap"] + step["hit"]).alias("at"),
                note(state["starts"], state["at"] + step["gap"]).alias("starts"),
            ),
        )
        hits = F.zip_with(
            found,
            noted(walked["starts"], "start"),
            lambda m, begin: F.struct(
                begin["start"].alias("start"),
                (begin["start"] + F.length(m)).alias("end"),
                rule["category"].alias("category"),
                (-rule["score"]).alias("rank"),
                rule["number"].alias("rule"),
                strip(m).alias("text"),
            ),
        )
        return F.filter(hits, lambda hit: hit["text"] != "")

    none = F.array().cast(f"array<{_RAW}>")
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))


def _disarmed(text: Column, openings: Sequence[tuple[str, str, str]]) -> Column:
    """The text, with every opening broken that nothing needed follows up to a closing.

    An opening is behind the last needed word that a closing follows, or it begins a
    match. Broken ones differ in their second character only. Each step is one pass.
    """

    def broken(opening: str, needed: str, closing: str):
        pattern = f"(?iu){re.escape(opening)}"
        filler = f"{opening[0]}_{opening[2:]}"

        def step(whole: Column) -> Column:
            closed = F.length(whole) - F.length(F.substring_index(whole, closing, -1))
            head = F.regexp_extract(F.substr(whole, F.lit(1), closed), rf"{FLAGS}\A.*{_classes(needed)}", 0)
            return let(
                head,
                lambda h: F.concat(h, F.regexp_replace(F.substr(whole, F.length(h) + 1), pattern, filler)),
            )

        return step

    return reduce(lambda value, opening: let(value, broken(*opening)), openings, text)


def _linear_matches(rule: Rule, row: Column, text: Column) -> Column:
    """Matches of a rule by its linear pattern.

    Behind disarmed openings the pattern never runs to the end in vain. Where no
    alternative matches it takes the stretch that cannot begin a match, and such
    hits, which no closing ends, are left out.
    """
    begins = "(?iu)" + "|".join(re.escape(opening) for opening, _, _ in rule.openings)

    def found(armed: Column) -> Column:
        def original(hits: Column) -> Column:
            ended = F.filter(
                hits, lambda hit: reduce(lambda a, b: a | b, (F.endswith(hit["text"], F.lit(c)) for _, _, c in rule.openings))
            )
            return paged(
                text,
                lambda cut: F.transform(ended, lambda hit: hit.withField("text", strip(cut(hit["start"], hit["end"])))),
            )

        none = F.array().cast(f"array<{_RAW}>")
        return F.when(armed.rlike(begins), let(_matches(row, armed), original)).otherwise(none)

    literal = F.contains(text, F.lit(rule.contains)) if rule.contains else F.lit(True)
    none = F.array().cast(f"array<{_RAW}>")
    return F.when(literal & text.rlike(begins), let(_disarmed(text, rule.openings), found)).otherwise(none)


def first_of_each_key(ordered: Column, same_key) -> Column:
    """Drop array elements with the key of the element before them."""
    return let(
        ordered,
        lambda items: F.filter(
            items, lambda item, i: (i == 0) | ~same_key(item, F.element_at(items, F.greatest(i, F.lit(1))))
        ),
    )


def _same_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["category"] == b["category"])


def find_spans(text: Column, rules: Sequence[Rule] | None = None, detector: str = "rule_scanner") -> Column:
    """All spans of a text, one per (start, end, category), in that order."""
    pack = check_rules(rules)
    table = _rule_table(pack, detector)
    words = _key_words(pack)
    factors = sorted({f for rule in pack for f in _factors(rule)})
    nothing = F.array().cast("array<string>")
    present = F.struct(
        (_words_present(text, words) if words else nothing).alias("words"), (_factors_present(text, factors) if factors else nothing).alias("factors")
    )

    def described(hit: Column) -> Column:
        rule = F.element_at(table, hit["rule"])
        return F.struct(
            *(hit[name].alias(name) for name in ("start", "end", "text", "category")),
            *(rule[name].alias(name) for name in ("score", "reason", "detector_name")),
        )

    linear = {number: rule for number, rule in enumerate(pack, start=1) if rule.linear}

    def scanned(found: Column) -> Column:
        candidates = F.filter(table, lambda rule: ~rule["number"].isin(*linear) & _may_match(rule, text, found["words"], found["factors"]))
        plain = F.flatten(F.transform(candidates, lambda rule: _matches(rule, text)))
        special = (_linear_matches(rule, F.element_at(table, number), text) for number, rule in linear.items())
        return let(
            F.concat(plain, *special),
            lambda raw: F.when(F.size(raw) == 0, F.array().cast(NO_SPANS)).otherwise(
                F.transform(first_of_each_key(F.sort_array(raw), _same_span), described)
            ),
        )

    return F.when(text.isNotNull(), let(present, scanned).cast(NO_SPANS))


def offset_spans(spans: Column, offset: Column) -> Column:
    """Shift spans by ``offset`` characters; a negative offset is an error."""
    shifted = F.transform(
        spans, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset)
    )
    return F.when(offset < 0, F.raise_error(F.lit("offset cannot be negative.")).cast(NO_SPANS)).otherwise(shifted)


def deduplicate_spans(spans: Column) -> Column:
    """Keep the best scoring span per (start, end, category); the first one wins ties."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"),
            (-s["score"]).alias("rank"), i.alias("at"), s.alias("span"),
        ),
    )
    return F.transform(first_of_each_key(F.sort_array(keyed), _same_span), lambda k: k["span"])
