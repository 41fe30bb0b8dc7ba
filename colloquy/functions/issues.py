"""Issue extraction: one issue per severity, stop after a pager severity.

For each severity in order, the first word (list order) found in the lower-cased
text summary + ' ' + moment texts makes one issue.  Its title is the first
key moment containing the word (80 chars, with that moment's type) or
'<SEV> signal: <word>' with type 'pattern_match'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import DEFAULT_RULES, ISSUE_TITLE_MAX_CHARS, RuleSet

ISSUE_TYPE = "struct<title:string,severity:string,type:string>"


def combined_text(summary: Column, key_moments: Column) -> Column:
    # key_moments.text extracts the field array without a lambda; NULL texts join as ''
    moments = F.coalesce(key_moments, F.array().cast("array<struct<text:string,type:string>>"))
    return F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.array_join(moments["text"], " ", "")))


def _first_word(text: Column, words) -> Column:
    """First word of the list (in list order) that occurs in ``text``: a CASE chain."""
    out = None
    for w in words:
        out = F.when(text.contains(F.lit(w)), F.lit(w)) if out is None else out.when(text.contains(F.lit(w)), F.lit(w))
    return out


def _issue(sev: str, word: Column, key_moments: Column) -> Column:
    moments = F.coalesce(key_moments, F.array().cast("array<struct<text:string,type:string>>"))
    found = F.get(F.filter(moments, lambda m: F.lower(F.coalesce(m["text"], F.lit(""))).contains(word)), 0)

    def issue(hit: Column) -> Column:
        title = F.coalesce(F.substring(hit["text"], 1, ISSUE_TITLE_MAX_CHARS),
                           F.concat(F.lit(sev.upper() + " signal: "), word))
        itype = F.when(hit.isNotNull(), F.coalesce(hit["type"], F.lit(""))).otherwise(F.lit("pattern_match"))
        return F.struct(title.alias("title"), F.lit(sev).alias("severity"), itype.alias("type"))

    # one-element array: the moments are searched once per issue, not once per field of it
    return F.when(word.isNotNull(), F.get(F.transform(F.array(found), issue), 0))


def first_words(text: Column, rules: RuleSet = DEFAULT_RULES) -> dict:
    """severity -> first word of its list found in ``text`` (NULL when none)."""
    return {sev: _first_word(text, ws) for sev, ws in rules.severity_words}


def issues_from_words(words: dict, key_moments: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Apply the stop rule: the first pager severity found alone, else every other hit."""
    issues = {sev: _issue(sev, words[sev], key_moments) for sev, _ in rules.severity_words}
    out = None
    rest = []
    for sev, _ in rules.severity_words:
        if sev in rules.pager_severities:
            cond = words[sev].isNotNull()
            arr = F.array(issues[sev])
            out = F.when(cond, arr) if out is None else out.when(cond, arr)
        else:
            rest.append(issues[sev])
    tail = F.array_compact(F.array(*rest)) if rest else F.array().cast(f"array<{ISSUE_TYPE}>")
    return out.otherwise(tail) if out is not None else tail


def severity_from_words(words: dict, rules: RuleSet = DEFAULT_RULES) -> Column:
    out = None
    for sev, _ in rules.severity_words:
        cond = words[sev].isNotNull()
        out = F.when(cond, F.lit(sev)) if out is None else out.when(cond, F.lit(sev))
    return out


def extract_issues(summary: Column, key_moments: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """array<struct<title,severity,type>> following the stop rule."""
    return issues_from_words(first_words(combined_text(summary, key_moments), rules), key_moments, rules)


def top_severity(summary: Column, key_moments: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Highest severity whose words occur, or NULL."""
    return severity_from_words(first_words(combined_text(summary, key_moments), rules), rules)
