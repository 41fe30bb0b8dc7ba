"""Call-type and category classifiers (ordered rule tables -> CASE chains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import DEFAULT_RULES, OTHER_CATEGORY, RuleSet


def keyword_regex(keywords) -> str:
    """Alternation of quoted literals: a find() of it == 'any keyword is a substring'."""
    return "|".join("\\Q" + k + "\\E" for k in keywords)


def any_keyword(text: Column, keywords) -> Column:
    """True when any keyword is a substring of ``text`` (substring, not word).

    One regex per keyword set keeps the generated code small (dozens of
    ``contains`` per row overflow the 64 KB method limit of whole-stage codegen)."""
    return F.coalesce(text.rlike(keyword_regex(keywords)), F.lit(False))


def call_type(title: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """support / external / internal; case-sensitive prefix match; NULL title -> internal."""
    t = F.coalesce(title, F.lit(""))
    return (F.when(t.rlike(rules.support_prefix), F.lit("support"))
            .when(t.rlike(rules.external_prefix), F.lit("external"))
            .otherwise(F.lit("internal")))


def title_level(title: Column, rules: RuleSet) -> Column:
    t = F.coalesce(title, F.lit(""))
    out = None
    for pattern, cat in rules.title_patterns:
        cond = t.rlike("(?iu)" + pattern)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out


def taxonomy_level(text: Column, rules: RuleSet) -> Column:
    out = None
    for cat, kws in rules.taxonomy:
        cond = any_keyword(text, kws)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out


def primary_topic(topics: Column) -> Column:
    return F.lower(F.coalesce(F.get(topics, 0), F.lit("")))


def all_topics(topics: Column) -> Column:
    return F.lower(F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "))


def category(title: Column, topics: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """3-level classifier: title regex, then first topic, then all topics, else 'Other'."""
    return F.coalesce(title_level(title, rules),
                      taxonomy_level(primary_topic(topics), rules),
                      taxonomy_level(all_topics(topics), rules),
                      F.lit(OTHER_CATEGORY))


def category_level(title: Column, topics: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Which level decided the category: 1, 2, 3 or 0 (none -> 'Other')."""
    return (F.when(title_level(title, rules).isNotNull(), F.lit(1))
            .when(taxonomy_level(primary_topic(topics), rules).isNotNull(), F.lit(2))
            .when(taxonomy_level(all_topics(topics), rules).isNotNull(), F.lit(3))
            .otherwise(F.lit(0)))


def l3_category(topics: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Single-level classifier over all topics joined (keywords only)."""
    return F.coalesce(taxonomy_level(all_topics(topics), rules), F.lit(OTHER_CATEGORY))


def taxonomy_hits(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Every category with a keyword in ``text``, in taxonomy order."""
    return F.array_compact(F.array(*[F.when(any_keyword(text, kws), F.lit(cat)) for cat, kws in rules.taxonomy]))


def topic_categories(topics: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Struct(primary, all): every matching category in taxonomy order, or ['Other']."""
    hits = taxonomy_hits(all_topics(topics), rules)
    all_cats = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(OTHER_CATEGORY)))
    return F.struct(F.get(all_cats, 0).alias("primary"), all_cats.alias("all"))


def topics_from_string(s: Column) -> Column:
    """Comma-separated topics -> trimmed, non-empty array."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.trim(x)),
                    lambda x: x != F.lit(""))
