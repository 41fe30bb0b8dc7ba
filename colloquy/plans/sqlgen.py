"""DuckDB SQL for the oracle: the meetings adapter and the enrichment, rendered
from the same templates and rule tables the Spark operators use.

Only the oracle uses this module; the engine itself never parses or plans SQL.
"""

from __future__ import annotations

from colloquy.rules import (DEFAULT_RULES, EXTERNAL_TITLE_PREFIX, ISSUE_TITLE_MAX_CHARS, OTHER_CATEGORY,
                            SUMMARY_MAX_CHARS, SUPPORT_COMPANY_FALLBACK_REGEX, SUPPORT_COMPANY_REGEX, RuleSet)
from colloquy.sources import meetings as M


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def any_kw(text: str, kws) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(k)})" for k in kws) + ")"


def case_chain(pairs, default: str | None = None) -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {body}" + (f" ELSE {default}" if default is not None else "") + " END"


def pick(index: str, options) -> str:
    return case_chain([(f"{index} = {i}", v) for i, v in enumerate(options)])


def render(template: str, values: dict) -> str:
    parts = [values[p[0]] if isinstance(p, tuple) else q(p) for p in M.template_parts(template)]
    if not parts:
        return "''"
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def list_lit(items) -> str:
    return "([" + ", ".join(q(i) for i in items) + "]::VARCHAR[])"


def duck_pattern(etype: str, pattern: str) -> str:
    # RE2 has no lookahead: the e-mail pattern drops its vendor lookaheads and the
    # vendor domains are filtered from the extracted matches instead.
    if etype == "EMAIL":
        pattern = pattern.replace(r"(?!aegiscloud\.com)(?!aegis\.com)", "")
    return "(?i)" + pattern


def vendor_filter(m: str, rules: RuleSet = DEFAULT_RULES) -> str:
    cond = " AND ".join(f"NOT starts_with(lower(split_part(v, '@', 2)), {q(d)})" for d in rules.vendor_email_domains)
    return f"list_filter({m}, lambda v: {cond})"


def pii_matches(text: str, etype: str, pattern: str) -> str:
    m = f"regexp_extract_all({text}, {q(duck_pattern(etype, pattern))}, 0)"
    return vendor_filter(m) if etype == "EMAIL" else m


def pii_placeholder(etype: str, original: str) -> str:
    return f"concat({q('[' + etype + '_')}, substr(md5(lower({original})), 1, 6), ']')"


def sanitized_ctes(source: str, out: str, rules: RuleSet = DEFAULT_RULES) -> str:
    """``out``: the meetings of ``source`` with redacted title, summary and attendees (the texts of
    topics, moments and action items are literals that no pattern matches)."""
    def fold(t, etype, pattern):
        return (f"list_reduce(list_prepend({t}, {pii_matches(t, etype, pattern)}), "
                f"lambda acc, x: replace(acc, x, {pii_placeholder(etype, 'x')}))")

    ctes, last = [], len(rules.pii_patterns)
    for i, (etype, pattern) in enumerate(rules.pii_patterns, 1):
        name, before = (out if i == last else f"{out}_{i}"), (source if i == 1 else f"{out}_{i - 1}")
        # materialized: a filter pushed through the ten steps would repeat the text's expression 2**10 times
        ctes.append(f"{name} AS {'MATERIALIZED ' if i == last else ''}(SELECT * REPLACE ({fold('title', etype, pattern)} AS title, {fold('summary', etype, pattern)} AS summary, "
                    f"list_transform(attendees, lambda a: {fold('a', etype, pattern)}) AS attendees) FROM {before})")
    return ",\n".join(ctes)


def meetings_ctes() -> str:
    km_text = pick("l_partkey % 8", [q(t) for t in M.MOMENT_TEXTS])
    km_type = pick("l_linenumber % 4", [q(t) for t in M.MOMENT_TYPES])
    order = ", ".join(M.MOMENT_ORDER)
    vals = {"K": "CAST(o.o_orderkey AS VARCHAR)", "C": "c.c_name",
            "K4": "lpad(CAST(o.o_orderkey % 10000 AS VARCHAR), 4, '0')"}
    k = "o.o_orderkey"
    score_h = f"CASE WHEN {k} % {M.NULL_SCORE_MODULUS} <> 0 THEN 100 + (({k} * 37) % 41) * 10 END"
    label = case_chain([(f"({score_h}) < {b}", q(n)) for b, n in M.LABEL_BANDS])
    topics = pick(f"{k} % {len(M.TOPIC_SETS)}", [list_lit(ts) for ts in M.TOPIC_SETS])
    return f"""
km_ranked AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS rn
  FROM lineitem
),
km AS (
  SELECT l_orderkey AS km_orderkey, list({{'text': text, 'type': type}} ORDER BY rn) AS key_moments, CAST(sum(n) AS INTEGER) AS n_moments
  FROM (SELECT l_orderkey, {km_text} AS text, {km_type} AS type, min(rn) AS rn, count(*) AS n
        FROM km_ranked GROUP BY l_orderkey, {km_text}, {km_type})
  GROUP BY l_orderkey
),
meetings_plain AS (
  SELECT CAST({k} AS VARCHAR) AS meeting_id,
         {k} AS k,
         {pick(f"{k} % {len(M.TITLE_TEMPLATES)}", [render(t, vals) for t in M.TITLE_TEMPLATES])} AS title,
         o.o_orderdate AS start_time,
         CAST(15 + ({k} % 8) * 5 AS DOUBLE) AS duration_min,
         [c.c_name, 'host@aegis.com', concat('guest', CAST({k} AS VARCHAR), '@example.org'), 'eng@aegiscloud.com'][1:1 + {k} % 4] AS attendees,
         ({score_h}) / 100 AS sentiment_score,
         {label} AS sentiment_label,
         {topics} AS topics,
         {pick(f"{k} % {len(M.SUMMARY_TEMPLATES)}", [render(t, vals) for t in M.SUMMARY_TEMPLATES])} AS summary,
         coalesce(km.key_moments, []::STRUCT(text VARCHAR, type VARCHAR)[]) AS key_moments,
         coalesce(km.n_moments, 0) AS n_key_moments,
         {list_lit(M.ACTION_ITEMS)}[1:{k} % 4] AS action_items,
         c.c_name AS account,
         c.c_mktsegment AS segment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN km ON km.km_orderkey = o.o_orderkey
),
{sanitized_ctes("meetings_plain", "meetings")}"""


def _title_level(t: str, rules: RuleSet) -> str:
    return case_chain([(f"regexp_matches({t}, {q(p)}, 'i')", q(c)) for p, c in rules.title_patterns])


def _tax_level(text: str, rules: RuleSet) -> str:
    return case_chain([(any_kw(text, kws), q(c)) for c, kws in rules.taxonomy])


def _first_word(text: str, words) -> str:
    return f"list_filter({list_lit(words)}, lambda w: contains({text}, w))[1]"


def _issue(sev: str, w: str) -> str:
    hit = f"list_filter(key_moments, lambda m: contains(lower(coalesce(m.text, '')), {w}))[1]"
    title = f"coalesce(substr({hit}.text, 1, {ISSUE_TITLE_MAX_CHARS}), concat({q(sev.upper() + ' signal: ')}, {w}))"
    itype = f"CASE WHEN {hit} IS NOT NULL THEN coalesce({hit}.type, '') ELSE 'pattern_match' END"
    return f"CASE WHEN {w} IS NOT NULL THEN {{'title': {title}, 'severity': {q(sev)}, 'type': {itype}}} END"


def enriched_ctes(rules: RuleSet = DEFAULT_RULES) -> str:
    t = "coalesce(title, '')"
    prim = "lower(coalesce(topics[1], ''))"
    allt = "lower(array_to_string(topics, ' '))"
    ctext = ("lower(concat(coalesce(summary, ''), ' ', "
             "array_to_string(list_transform(key_moments, lambda m: coalesce(m.text, '')), ' ')))")
    words = [(sev, ws) for sev, ws in rules.severity_words]
    w_cols = ", ".join(f"{_first_word('ctext', ws)} AS w_{sev}" for sev, ws in words)
    issue_cols = ", ".join(f"{_issue(sev, 'w_' + sev)} AS i_{sev}" for sev, _ in words)
    pager = [s for s, _ in words if s in rules.pager_severities]
    rest = [s for s, _ in words if s not in rules.pager_severities]
    issues = case_chain([(f"w_{s} IS NOT NULL", f"[i_{s}]") for s in pager],
                        "list_filter([" + ", ".join(f"i_{s}" for s in rest) + "], lambda x: x IS NOT NULL)")
    severity = case_chain([(f"w_{s} IS NOT NULL", q(s)) for s, _ in words])
    base = case_chain([(f"call_type = {q(ct)}", str(int(round(b * 100)))) for ct, b in rules.baselines],
                      str(int(round(rules.default_baseline * 100))))
    std_h = int(round(rules.std_dev * 100))
    l1 = _title_level(t, rules)
    l2 = _tax_level(prim, rules)
    l3 = _tax_level(allt, rules)
    topic_hits = "list_filter([" + ", ".join(f"CASE WHEN {any_kw(allt, kws)} THEN {q(c)} END"
                                             for c, kws in rules.taxonomy) + "], lambda x: x IS NOT NULL)"
    rule_team = case_chain([(f"category = {q(c)} AND severity = {q(s)}", q(tm)) for c, s, tm in rules.escalation_rules])
    pagers = ", ".join(q(s) for s in rules.pager_severities)
    is_pager = f"coalesce(severity IN ({pagers}), false)"
    fallback = (f"CASE WHEN is_anomaly AND coalesce(sentiment_score < 2.5, false) THEN 'cs' "
                f"WHEN {is_pager} THEN 'engineering' ELSE 'support' END")
    acct_re = q("(?i)" + rules.external_account_regex)
    pfx = q(EXTERNAL_TITLE_PREFIX)
    rf = (f"CASE WHEN strpos({t}, {pfx}) > 0 THEN concat(substr({t}, 1, strpos({t}, {pfx}) - 1), "
          f"substr({t}, strpos({t}, {pfx}) + {len(EXTERNAL_TITLE_PREFIX)})) ELSE {t} END")
    issue_titles = "array_to_string(list_transform(issues, lambda i: coalesce(i.title, '')), ' ')"
    fg_text = f"lower(concat({t}, ' ', {issue_titles}))"
    return f"""{meetings_ctes()},
e1 AS (
  SELECT *,
    CASE WHEN regexp_matches({t}, {q(rules.support_prefix)}) THEN 'support'
         WHEN regexp_matches({t}, {q(rules.external_prefix)}) THEN 'external' ELSE 'internal' END AS call_type,
    coalesce({l1}, {l2}, {l3}, {q(OTHER_CATEGORY)}) AS category,
    CASE WHEN {l1} IS NOT NULL THEN 1 WHEN {l2} IS NOT NULL THEN 2 WHEN {l3} IS NOT NULL THEN 3 ELSE 0 END AS category_level,
    coalesce({topic_hits}[1], {q(OTHER_CATEGORY)}) AS topic_category,
    CASE WHEN len({topic_hits}) > 0 THEN array_to_string({topic_hits}, '|') ELSE {q(OTHER_CATEGORY)} END AS topic_categories_all,
    coalesce({l3}, {q(OTHER_CATEGORY)}) AS l3_category,
    {ctext} AS ctext,
    strftime(start_time, '%Y-%m') AS month,
    CAST(round(sentiment_score * 100) AS BIGINT) AS score_h
  FROM meetings
),
e2 AS (SELECT *, {w_cols} FROM e1),
e3 AS (SELECT *, {issue_cols} FROM e2),
e4 AS (
  SELECT *, {issues} AS issues, {severity} AS severity,
    ({base}) / 100 AS baseline,
    floor((score_h - ({base})) * 100 / {std_h} + 0.5) / 100 AS z_score
  FROM e3
),
e5 AS (
  SELECT *, coalesce(abs(z_score) > {rules.z_threshold}, false) AS is_anomaly, CAST(len(issues) AS INTEGER) AS n_issues
  FROM e4
),
enriched AS (
  SELECT *,
    coalesce({rule_team}, {fallback}) AS escalation_team,
    coalesce(nullif(severity, ''), 'p3') AS escalation_priority,
    {is_pager} AS has_pagerduty,
    {is_pager} OR is_anomaly AS requires_escalation,
    CASE WHEN is_anomaly OR {is_pager} THEN coalesce({rule_team}, {fallback}) END AS notebook_team,
    CASE WHEN call_type = 'external' THEN trim(regexp_extract(trim({t}), {acct_re}, 1)) ELSE '' END AS account_name,
    trim(regexp_extract({t}, {acct_re}, 1)) AS title_account,
    CASE WHEN call_type = 'external' AND starts_with({t}, 'Aegis /') THEN trim(split_part({rf}, ' - ', 1))
         WHEN call_type = 'support' THEN coalesce(nullif(trim(regexp_extract({t}, {q('^' + SUPPORT_COMPANY_REGEX)}, 1)), ''),
                                                 nullif(trim(regexp_extract({t}, {q('^' + SUPPORT_COMPANY_FALLBACK_REGEX)}, 1)), ''))
    END AS company,
    split_part(replace({t}, {pfx}, ''), ' - ', 1) AS company_simple,
    coalesce(category = {q(rules.feature_gap_category)}, false) OR {any_kw(fg_text, rules.feature_gap_keywords)} AS feature_gap,
    len(list_filter(key_moments, lambda m: m.type = 'churn_signal')) > 0 AS has_churn_signal,
    len(list_filter(key_moments, lambda m: m.type = 'feature_gap')) > 0 AS has_feature_gap,
    len(list_filter(key_moments, lambda m: m.type = 'praise')) > 0 AS has_praise,
    {any_kw(f"lower({t})", rules.outage_keywords)} OR {any_kw(allt, rules.outage_keywords)} AS outage_related,
    CAST(len(attendees) AS INTEGER) AS n_attendees,
    CAST(len(action_items) AS INTEGER) AS n_actions,
    substr(coalesce(summary, ''), 1, {SUMMARY_MAX_CHARS}) AS summary_short,
    start_time AS processed_at,
    'processed' AS processed_bucket
  FROM e5
)"""


def with_enriched(select_sql: str, extra_ctes: str = "", rules: RuleSet = DEFAULT_RULES) -> str:
    """WITH <adapter + enrichment>[, extra] <select>."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {enriched_ctes(rules)}{extra}\n{select_sql}"
