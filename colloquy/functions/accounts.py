"""Account / company name extraction from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.rules import (DEFAULT_RULES, EXTERNAL_TITLE_PREFIX, SUPPORT_COMPANY_FALLBACK_REGEX,
                            SUPPORT_COMPANY_REGEX, RuleSet)


def account_from_title(title: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """'Aegis / Acme - Renewal' -> 'Acme'; '' when the title does not match."""
    return F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), "(?iu)" + rules.external_account_regex, 1))


def account_name(title: Column, call_type: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """External meetings only; '' otherwise."""
    return F.when(call_type == F.lit("external"),
                  F.trim(F.regexp_extract(F.trim(F.coalesce(title, F.lit(""))),
                                          "(?iu)" + rules.external_account_regex, 1))
                  ).otherwise(F.lit(""))


def _replace_first(s: Column, old: str, new: str) -> Column:
    pos = F.instr(s, old)
    return F.when(pos > 0, F.concat(F.substring(s, F.lit(1), pos - 1), F.lit(new),
                                    F.substring(s, pos + F.lit(len(old)), F.lit(1 << 30)))).otherwise(s)


def company(title: Column, call_type: Column) -> Column:
    """External: text after the prefix up to ' - '; support: name after the case number; else NULL."""
    t = F.coalesce(title, F.lit(""))
    ext = F.trim(F.split_part(_replace_first(t, EXTERNAL_TITLE_PREFIX, ""), F.lit(" - "), F.lit(1)))
    sup = F.coalesce(F.nullif(F.trim(F.regexp_extract(t, "^" + SUPPORT_COMPANY_REGEX, 1)), F.lit("")),
                     F.nullif(F.trim(F.regexp_extract(t, "^" + SUPPORT_COMPANY_FALLBACK_REGEX, 1)), F.lit("")))
    return (F.when((call_type == F.lit("external")) & t.startswith(F.lit("Aegis /")), ext)
            .when(call_type == F.lit("support"), sup))


def company_simple(title: Column) -> Column:
    """Remove every 'Aegis / ' and keep the text before the first ' - '."""
    return F.split_part(F.replace(F.coalesce(title, F.lit("")), F.lit(EXTERNAL_TITLE_PREFIX), F.lit("")),
                        F.lit(" - "), F.lit(1))
