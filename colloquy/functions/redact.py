"""Personal-data redaction as Catalyst expressions.

Patterns run in rule order.  For each pattern, all matches are found on the text
as it stands before that pattern; each distinct match (in order of first
appearance) is then replaced everywhere by ``[TYPE_<first 6 hex of md5(lower(match))>]``;
the count adds every match, repeats included.

Every pattern has a necessary condition (``RuleSet.pii_needs``).  A text that meets none is not
touched, and a step runs only on a text that meets its own.

Each step wraps the running state in a one-element array and maps over it, so
the state expression is referenced once per step (a plain nested fold would
reference it twice and double the expression tree per pattern).
"""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import DEFAULT_RULES, PII_PATTERNS, RuleSet

MATCH_TYPE = "array<struct<pidx:int,pos:int,entity_type:string,original:string>>"


def java_pattern(pattern: str) -> str:
    """Case-insensitive, Unicode classes and case folding (as str patterns behave in Python)."""
    return "(?iU)" + pattern


def placeholder(entity_type: str, original: Column) -> Column:
    return F.concat(F.lit(f"[{entity_type}_"), F.substring(F.md5(F.lower(original)), 1, 6), F.lit("]"))


def need(pattern: str, rules: RuleSet = DEFAULT_RULES) -> str:
    """Pattern that every text with a match of ``pattern`` matches too."""
    return rules.pii_needs.get(pattern, pattern)


def _step(state: Column, pidx: int, etype: str, pattern: str, rules: RuleSet, keep_matches: bool) -> Column:
    def with_matches(s: Column, m: Column) -> Column:
        text = F.aggregate(F.array_distinct(m), s["text"], lambda acc, x: F.replace(acc, x, placeholder(etype, x)))
        fields = [F.when(m.isNull(), s["text"]).otherwise(text).alias("text"),
                  (s["n"] + F.coalesce(F.size(m), F.lit(0))).alias("n")]
        if keep_matches:
            new = F.transform(F.coalesce(m, F.array().cast("array<string>")),
                              lambda x, i: F.struct(F.lit(pidx).alias("pidx"), (i + 1).alias("pos"),
                                                    F.lit(etype).alias("entity_type"), x.alias("original")))
            fields.append(F.concat(s["matches"], new).alias("matches"))
        return F.struct(*fields)

    def step(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(java_pattern(pattern)), 0)
        if _plain(pattern):
            found = F.when(_is_ascii(s["text"]), F.regexp_extract_all(s["text"], F.lit("(?i)" + pattern), 0)).otherwise(found)
        return F.when(pii_possible(s["text"], rules, [pattern]), F.get(F.transform(F.array(found), lambda m: with_matches(s, m)), 0)).otherwise(s)

    return F.get(F.transform(F.array(state), step), 0)


def redact(text: Column, rules: RuleSet = DEFAULT_RULES, keep_matches: bool = False) -> Column:
    """struct<text, n[, matches]>; NULL text stays NULL with n = 0."""
    fields = [text.alias("text"), F.lit(0).alias("n")]
    if keep_matches:
        fields.append(F.array().cast(MATCH_TYPE).alias("matches"))
    untouched = F.struct(*fields)
    steps = [(i + 1, etype, pattern) for i, (etype, pattern) in enumerate(rules.pii_patterns)]
    first = sum(1 for _ in takewhile(lambda x: rules.pii_marks.get(x[2]) == rules.pii_marks.get(steps[0][2]), steps))

    def chain(state: Column, some: list) -> Column:
        for i, etype, pattern in some:
            state = _step(state, i, etype, pattern, rules, keep_matches)
        return state

    # Exact shortcuts: if no pattern can match a text, no step rewrites it, so no later step can
    # match either.  Most texts skip the chain entirely, most others what follows its first patterns.
    state = chain(untouched, steps[:first])
    if rest := steps[first:]:
        state = F.get(F.transform(F.array(state), lambda s: F.when(
            pii_possible(s["text"], rules, [p for _, _, p in rest]), chain(s, rest)).otherwise(s)), 0)
    return F.when(pii_possible(text, rules), state).otherwise(untouched)


def pii_possible(text: Column, rules: RuleSet = DEFAULT_RULES, patterns: list | None = None) -> Column:
    """Cheap necessary condition for a match of any of ``patterns`` (all): their conditions as one alternation."""
    patterns = [p for _, p in rules.pii_patterns] if patterns is None else patterns
    needs = list(dict.fromkeys(need(p, rules) for p in patterns))
    out = text.rlike("|".join(f"(?:{java_pattern(n)})" for n in needs))
    if all(_plain(n) for n in needs):
        groups = {}  # mark -> needs of the patterns with it
        for p in patterns:
            groups.setdefault(rules.pii_marks.get(p), []).append(need(p, rules))
        narrow = F.lit(False)
        for mark, some in groups.items():
            hit = text.rlike("(?i)" + "|".join(f"(?:{n})" for n in dict.fromkeys(some)))
            narrow = narrow | (hit if mark is None else _has_mark(text, mark) & hit)
        out = F.when(_is_ascii(text), narrow).otherwise(out)
    return F.coalesce(out, F.lit(False))


def unmarked(texts: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """True only if no pattern can match any of ``texts`` (array of strings): all are scanned as one text."""
    return F.coalesce(~_marked(F.array_join(texts, "\n"), [p for _, p in rules.pii_patterns], rules), F.lit(False))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _plain(pattern: str) -> bool:
    """On ASCII texts this pattern needs no Unicode classes or case folding."""
    return pattern.isascii() and "\\p" not in pattern.lower()


def _has_mark(text: Column, mark: str) -> Column:
    """Whether the ASCII ``text`` has the mark: a character of a class, or a literal in any case."""
    if not mark.startswith("["):
        return F.lower(text).contains(F.lit(mark.lower()))
    return text.contains(F.lit(mark[1])) if len(mark) == 3 else text.rlike(mark)


def _marked(text: Column, patterns: list, rules: RuleSet) -> Column:
    """False only if ``text`` is ASCII and has no mark of any of ``patterns``."""
    if any(p not in rules.pii_marks for p in patterns):
        return F.lit(True)
    out = ~_is_ascii(text)
    for mark in dict.fromkeys(rules.pii_marks[p] for p in patterns):
        out = out | _has_mark(text, mark)
    return out


def any_pii(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """True when any pattern matches (cheap pre-filter for large corpora)."""
    return F.coalesce(text.rlike("|".join(f"(?:{java_pattern(p)})" for _, p in rules.pii_patterns)), F.lit(False))
