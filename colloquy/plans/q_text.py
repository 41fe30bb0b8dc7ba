"""Text operators: redaction (D-01..D-03, E-03), BM25 (D-24, D-29, D-30, T-04), transcripts (D-31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import conversations as C
from colloquy.operators import redaction as RD
from colloquy.operators import search as S
from colloquy.operators.briefing import CALL_TYPE_LABELS, briefing_lines
from colloquy.operators.records import enriched
from colloquy.plans import register
from colloquy.plans.sqlgen import enriched_ctes, meetings_ctes, pii_matches, pii_placeholder, q, with_enriched
from colloquy.plans.q_reports import ACCOUNT_SQL, EVIDENCE_SQL, REASONING_SQL, mh, rt
from colloquy.rules import CALL_TYPES, DEFAULT_RULES, SEARCH_B, SEARCH_K1
from colloquy.sources.meetings import meetings_raw
from colloquy.sources.tables import table

DOC_QUERY = "the stupid worthless data"
RECORD_QUERY = "outage engineering dashboard down"


# --- DuckDB rendering of the redaction chain --------------------------------------------------
def redaction_ctes(source: str, id_col: str, text_col: str, prefix: str = "r") -> str:
    """CTEs {prefix}0..{prefix}10: the text after each pattern (t_i) and the running count (n_i)."""
    r = prefix
    ctes = [f"{r}0 AS (SELECT {id_col} AS source_id, {text_col} AS t0, 0 AS n0 FROM {source})"]
    for i, (etype, pattern) in enumerate(DEFAULT_RULES.pii_patterns, start=1):
        m, ph = pii_matches(f"t{i-1}", etype, pattern), pii_placeholder(etype, "x")
        ctes.append(f"""{r}{i}m AS (SELECT *, {m} AS m{i} FROM {r}{i-1}),
{r}{i} AS (SELECT *, CASE WHEN m{i} IS NULL THEN t{i-1}
                        ELSE list_reduce(list_prepend(t{i-1}, m{i}), lambda acc, x: replace(acc, x, {ph})) END AS t{i},
                   n{i-1} + coalesce(len(m{i}), 0) AS n{i} FROM {r}{i}m)""")
    return ",\n".join(ctes)


_NP = len(DEFAULT_RULES.pii_patterns)
_MATCH_ROWS = " UNION ALL ".join(
    f"SELECT source_id, {i} AS pidx, unnest(m{i}) AS original, generate_subscripts(m{i}, 1) AS pos, {q(e)} AS entity_type FROM r{_NP}"
    for i, (e, _) in enumerate(DEFAULT_RULES.pii_patterns, start=1))

register("d01_redact_documents", f"WITH {redaction_ctes('documents', 'doc_id', 'text')} "
         f"SELECT source_id AS doc_id, t{_NP} AS redacted_text, CAST(n{_NP} AS INTEGER) AS n_redacted FROM r{_NP}")(
    lambda spark, sf: RD.redact_column(table(spark, sf, "documents").select("doc_id", "text"), "text", out="redacted_text")
    .select("doc_id", "redacted_text", "n_redacted"))

_MATCHES_CTE = (f"matches AS (SELECT *, concat('[', entity_type, '_', substr(md5(lower(original)), 1, 6), ']') AS placeholder "
                f"FROM ({_MATCH_ROWS}))")
register("d03_pii_vault", f"WITH {redaction_ctes('documents', 'doc_id', 'text')}, {_MATCHES_CTE} "
         "SELECT placeholder, arg_max(original, {'s': source_id, 'p': pidx, 'q': pos}) AS original, "
         "arg_max(entity_type, {'s': source_id, 'p': pidx, 'q': pos}) AS entity_type, "
         "arg_max(source_id, {'s': source_id, 'p': pidx, 'q': pos}) AS source_id, count(*) AS n_matches "
         "FROM matches GROUP BY placeholder")(
    lambda spark, sf: RD.pii_vault(RD.match_rows(table(spark, sf, "documents"), "doc_id", "text")))
register("d03b_pii_matches", f"WITH {redaction_ctes('documents', 'doc_id', 'text')}, {_MATCHES_CTE} "
         "SELECT source_id, pidx, CAST(pos AS INTEGER) AS pos, entity_type, original, placeholder FROM matches")(
    lambda spark, sf: RD.match_rows(table(spark, sf, "documents"), "doc_id", "text"))
register("e03_redaction_leak_check", f"WITH {redaction_ctes('documents', 'doc_id', 'text')}, {_MATCHES_CTE} "
         f"SELECT m.source_id, m.original FROM matches m JOIN r{_NP} r ON r.source_id = m.source_id "
         f"WHERE contains(r.t{_NP}, m.original)")(
    lambda spark, sf: RD.leak_check(table(spark, sf, "documents"), "doc_id", "text"))


def _residue(text: str) -> str:
    """Matches that any pattern still has in ``text``."""
    return " + ".join(f"coalesce(len({pii_matches(text, e, p)}), 0)" for e, p in DEFAULT_RULES.pii_patterns)


register("e03b_leak_report", f"WITH {redaction_ctes('documents', 'doc_id', 'text')} "
         f"SELECT count(*) AS n_texts, count_if(n{_NP} > 0) AS n_redacted, CAST(sum(n{_NP}) AS BIGINT) AS n_matches, "
         f"CAST(sum({_residue(f't{_NP}')}) AS BIGINT) AS n_left FROM r{_NP}")(
    lambda spark, sf: RD.leak_report(table(spark, sf, "documents"), "text"))


def _redacted_meetings(spark, sf):
    return RD.redact_record(meetings_raw(spark, sf).select("meeting_id", *RD.MEETING_TEXT_COLUMNS), RD.MEETING_TEXT_COLUMNS)


register("d02_redact_meeting_record")(_redacted_meetings)  # nested struct/array leaves: d02c has the same leaves as rows


def meeting_leaves(spark, sf):
    """The redacted record's string leaves as rows."""
    def leaf(name, value, pos=F.lit(1)):
        return F.struct(F.concat_ws("|", "meeting_id", F.lit(name), pos.cast("string")).alias("leaf_id"), value.alias("value"))

    def numbered(column, name, value=lambda x: x):
        return F.transform(column, lambda x, i: leaf(name, value(x), i + 1))

    lists = [numbered(c, c) for c in ("attendees", "topics", "action_items")]
    lists += [numbered("key_moments", "moment_text", lambda x: x["text"]), numbered("key_moments", "moment_type", lambda x: x["type"])]
    leaves = F.concat(F.array(leaf("title", F.col("title")), leaf("summary", F.col("summary"))), *lists)
    return _redacted_meetings(spark, sf).select(F.explode(leaves).alias("l")).select("l.*")


def _leaf_sql(name: str, values: str) -> str:
    return (f"SELECT concat_ws('|', meeting_id, {q(name)}, CAST(generate_subscripts({values}, 1) AS VARCHAR)) AS leaf_id, "
            f"unnest({values}) AS value FROM meetings_plain")


_LEAVES_SQL = " UNION ALL ".join(
    [_leaf_sql(c, f"[{c}]") for c in ("title", "summary")] + [_leaf_sql(c, c) for c in ("attendees", "topics", "action_items")]
    + [_leaf_sql("moment_" + f, f"list_transform(key_moments, lambda m: m.{f})") for f in ("text", "type")])
register("d02c_redact_meeting_leaves", f"WITH {meetings_ctes()},\nleaves AS ({_LEAVES_SQL}),\n{redaction_ctes('leaves', 'leaf_id', 'value')} "
         f"SELECT source_id AS leaf_id, t{_NP} AS value FROM r{_NP}")(meeting_leaves)


# --- J-12 vault reverse lookup, E-03 on the stored records ----------------------------------------
def vault_reverse_lookup(spark, sf):
    """Summaries of the stored records with the placeholders put back from the meetings' vault."""
    m = meetings_raw(spark, sf).select("meeting_id", "summary")
    vault = RD.pii_vault(RD.match_rows(m, "meeting_id", "summary"))
    return RD.reveal(enriched(spark, sf).select("meeting_id", "summary"), "meeting_id", "summary", vault)


register("j12_vault_reverse_lookup", f"""WITH {meetings_ctes()},
{redaction_ctes('meetings_plain', 'meeting_id', 'summary')}, {_MATCHES_CTE},
vault AS (SELECT placeholder, arg_max(original, {{'s': source_id, 'p': pidx, 'q': pos, 'o': original}}) AS original FROM matches GROUP BY placeholder),
found AS (SELECT DISTINCT source_id, unnest(regexp_extract_all(t{_NP}, '\\[[A-Z_]+_[0-9a-f]{{6}}\\]', 0)) AS placeholder FROM r{_NP}),
pairs AS (SELECT source_id, list({{'p': placeholder, 'o': original}} ORDER BY placeholder) AS ps FROM found JOIN vault USING (placeholder) GROUP BY source_id)
SELECT r.source_id AS meeting_id, list_reduce(list_prepend({{'p': '', 'o': t{_NP}}}, coalesce(ps, [])),
         lambda acc, x: {{'p': '', 'o': replace(acc.o, x.p, x.o)}}).o AS summary
FROM r{_NP} r LEFT JOIN pairs USING (source_id)""")(vault_reverse_lookup)


def gold_leak_report(spark, sf):
    """Texts of the stored records, those with a placeholder, and matches of any pattern left in them."""
    e = enriched(spark, sf)
    texts = e.select(F.explode(F.concat(F.array("title", "summary"), "attendees")).alias("text"))
    return texts.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(RD.residue(F.col("text"))).alias("n_left"),
                     F.count_if(F.col("text").rlike(r"\[[A-Z_]+_[0-9a-f]{6}\]")).alias("n_marked"))


register("e03c_gold_leak_report", with_enriched(f"""
SELECT count(*) AS n_texts, CAST(sum({_residue('text')}) AS BIGINT) AS n_left,
       count_if(regexp_matches(text, '\\[[A-Z_]+_[0-9a-f]{{6}}\\]')) AS n_marked
FROM (SELECT unnest(list_concat([title, summary], attendees)) AS text FROM enriched)"""))(gold_leak_report)


# --- BM25 ----------------------------------------------------------------------------------------
def _bm25_sql(docs_sql: str, query: str, k: int | None) -> str:
    terms = S.query_terms(query)
    qrows = " UNION ALL ".join(f"SELECT {q(t)} AS term, {n} AS qn" for t, n in terms.items())
    tok = r"[\p{L}\p{N}_]+"
    qlist = "[" + ", ".join(q(t) for t in terms) + "]::VARCHAR[]"
    body = f"""WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(txt, '')), '{tok}', 0) AS tokens FROM ({docs_sql})),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM docs),
qt AS ({qrows}),
hits AS (SELECT doc_id, dl, term, count(*) AS tf FROM (
           SELECT doc_id, len(tokens) AS dl, unnest(list_filter(tokens, lambda t: list_contains({qlist}, t))) AS term FROM docs)
         GROUP BY doc_id, dl, term),
dft AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scores AS (
  SELECT h.doc_id, sum(qt.qn * ln((stats.n_docs - dft.df + 0.5) / (dft.df + 0.5) + 1.0) * (h.tf * {SEARCH_K1 + 1})
                       / (h.tf + {SEARCH_K1} * ({1 - SEARCH_B} + {SEARCH_B} * h.dl / stats.avgdl))) AS score
  FROM hits h JOIN dft USING (term) JOIN qt USING (term), stats GROUP BY h.doc_id)
"""
    if k is None:
        return body + "SELECT doc_id, score FROM scores"
    return body + (f"SELECT doc_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM scores WHERE score > 0 "
                   f"ORDER BY score DESC, doc_id LIMIT {min(max(1, k), 20)}")


def _docs_top(spark, sf, k):
    d = table(spark, sf, "documents")
    return S.top_k(S.bm25(d, "doc_id", F.col("text"), DOC_QUERY, index=S.document_index(spark, sf)), "doc_id", k)


register("d29_bm25_documents_top5", _bm25_sql("SELECT doc_id, text AS txt FROM documents", DOC_QUERY, 5))(
    lambda spark, sf: _docs_top(spark, sf, 5))
register("t04_bm25_documents_top20", _bm25_sql("SELECT doc_id, text AS txt FROM documents", DOC_QUERY, 20))(
    lambda spark, sf: _docs_top(spark, sf, 20))
register("d29b_bm25_documents_scores",
         "SELECT doc_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM ("
         + _bm25_sql("SELECT doc_id, text AS txt FROM documents", DOC_QUERY, None) + ")")(
    lambda spark, sf: S.bm25(table(spark, sf, "documents"), "doc_id", F.col("text"), DOC_QUERY, index=S.document_index(spark, sf))
    .select("doc_id", (F.floor(F.col("score") * 1_000_000 + 0.5) / 1_000_000).alias("score")))

_ISSUES3 = "array_to_string(list_transform(issues[1:3], lambda i: coalesce(i.title, '')), ' ')"
_CHAT_DOC = ("concat_ws(' ', nullif(title, ''), nullif(account_name, ''), nullif(call_type, ''), nullif(category, ''), "
             f"nullif(sentiment_label, ''), nullif(escalation_team, ''), nullif(escalation_priority, ''), nullif({_ISSUES3}, ''))")
_SERVER_DOC = ("concat_ws(' ', nullif(title, ''), nullif(call_type, ''), nullif(category, ''), nullif(sentiment_label, ''), "
               f"nullif({_ISSUES3}, ''))")
register("d24_search_document", with_enriched(f"SELECT meeting_id, {_CHAT_DOC} AS chat_doc, {_SERVER_DOC} AS server_doc FROM enriched"))(
    lambda spark, sf: enriched(spark, sf).select("meeting_id", S.record_doc("chat").alias("chat_doc"),
                                                 S.record_doc("server").alias("server_doc")))


def _records_top(spark, sf, version, k):
    e = enriched(spark, sf)
    scores = S.bm25(e, "meeting_id", S.record_doc(version), RECORD_QUERY, index=S.records_index(spark, sf, version))
    return S.top_k(scores, "meeting_id", k).withColumnRenamed("meeting_id", "doc_id")


def _records_bm25_sql(doc_sql: str, k: int) -> str:
    body = _bm25_sql("SELECT doc_id, txt FROM src", RECORD_QUERY, k)
    assert body.startswith("WITH ")
    return (f"WITH {enriched_ctes()},\nsrc AS (SELECT meeting_id AS doc_id, {doc_sql} AS txt FROM enriched),\n"
            + body[len("WITH "):])


register("t04b_bm25_records_chat_top5", _records_bm25_sql(_CHAT_DOC, 5))(
    lambda spark, sf: _records_top(spark, sf, "chat", 5))
register("t04c_bm25_records_server_top20", _records_bm25_sql(_SERVER_DOC, 20))(
    lambda spark, sf: _records_top(spark, sf, "server", 20))
def _s(x: str) -> str:
    """A value as format_string prints it."""
    return f"coalesce(CAST({x} AS VARCHAR), 'null')"


def _context_sql() -> str:
    body, _, top = _records_bm25_sql(_CHAT_DOC, 5).rpartition("SELECT doc_id, floor(")
    issues = ("array_to_string(list_transform(issues[1:3], lambda i: concat(upper(coalesce(i.severity, '?')), ': ', coalesce(i.title, ''))), '; ')")
    lines = [("meeting_id:  ", _s("meeting_id")), ("\ntitle:       ", _s("title")),
             ("\naccount:     ", "coalesce(nullif(account_name, ''), '-')"), ("\ncall_type:   ", _s("call_type")),
             ("\ncategory:    ", _s("category")), ("\nsentiment:   ", _s("sentiment_label")), ("  (score=", _s("sentiment_score")),
             ("  z=", _s("z_score")), ("  anomaly=", _s("is_anomaly")), (")\nescalation:  team=", _s("escalation_team")),
             ("  priority=", _s("escalation_priority")), ("  pagerduty=", _s("has_pagerduty")), ("\nfeature_gap: ", _s("feature_gap")),
             ("\nissues:      ", f"coalesce(nullif({issues}, ''), 'none')"), ("\nmonth:       ", _s("month"))]
    block = "concat(" + ", ".join(f"{q(a)}, {b}" for a, b in lines) + ")"
    return f"{body.rstrip()},\ntop AS (SELECT doc_id, floor({top})\nSELECT meeting_id, score, {block} AS context FROM enriched JOIN top ON doc_id = meeting_id"


register("d25_context_blocks", _context_sql())(
    lambda spark, sf: S.context_block(
        enriched(spark, sf).join(_records_top(spark, sf, "chat", 5).withColumnRenamed("doc_id", "meeting_id"), "meeting_id")))

# --- D-30 tokenizer, D-31 transcript metrics ----------------------------------------------------
register("d30_tokenize_counts", r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+', 0)) AS INTEGER) AS n_tokens,
       CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+', 0))) AS INTEGER) AS n_distinct
FROM documents""")(lambda spark, sf: table(spark, sf, "documents").select(
    "doc_id", F.size(S.tokens(F.col("text"))).alias("n_tokens"),
    F.size(F.array_distinct(S.tokens(F.col("text")))).alias("n_distinct")))
register("d31_transcript_metrics", r"""
SELECT conv_id, count(*) AS n_turns,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+', 0))) AS BIGINT) AS n_words,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[.!?]+', 0))) AS BIGINT) AS n_sentences,
       count(DISTINCT role) AS n_speakers, count_if(role = 'user') AS user_turns, count_if(role = 'assistant') AS assistant_turns
FROM conversations GROUP BY conv_id""")(lambda spark, sf: C.transcript_metrics(table(spark, sf, "conversations")))

# --- D-26 briefing -----------------------------------------------------------------------------
def _briefing_sql() -> str:
    pct = lambda n: f"coalesce(CAST(round({n} * 100 / nullif(total, 0)) AS BIGINT), 0)"
    kpi = ("concat_ws(chr(10), '── KPI SUMMARY ──', concat('Total Meetings Processed:  ', total), "
           f"concat('Anomalies Flagged:         ', anomalies, ' (', {pct('anomalies')}, '% of all meetings)'), "
           "concat('Average Sentiment Score:   ', avg_s, '/5.0'), "
           f"concat('Meetings Escalated P0/P1:  ', escalated, ' (', {pct('escalated')}, '% of all meetings)'), "
           "concat('Feature Gaps Identified:   ', gaps))")
    dom = " UNION ALL ".join(f"SELECT {q(c)} AS call_type, {i} AS ord, {q(CALL_TYPE_LABELS[c])} AS label" for i, c in enumerate(CALL_TYPES, 1))
    out = [f"""SELECT 1 AS section, 1 AS ord, {kpi} AS line FROM (
  SELECT count(*) AS total, count_if(is_anomaly) AS anomalies, count_if(escalation_priority IN ('p0', 'p1')) AS escalated,
         count_if(feature_gap) AS gaps,
         coalesce({mh("sum(CASE WHEN coalesce(score_h, 0) <> 0 THEN score_h END)", "count(CASE WHEN coalesce(score_h, 0) <> 0 THEN 1 END)")}, 0.0) AS avg_s
  FROM enriched)""",
           f"""SELECT 2, CAST(ord AS INTEGER), concat('  ', label, ': ', n, ' meetings (', {rt("n * 100", "sum(n) OVER ()", 1)}, '%)') FROM (
  SELECT d.*, coalesce(c.n, 0) AS n FROM ({dom}) d LEFT JOIN (SELECT call_type, count(*) AS n FROM enriched GROUP BY 1) c USING (call_type))""",
           f"""SELECT 3, CAST(row_number() OVER (ORDER BY z, meeting_id) AS INTEGER), concat('  [', upper(escalation_priority), '] ',
    {_s(ACCOUNT_SQL)}, ' | ', {_s('call_type')}, ' | ', {_s('category')}, ' | ', {_s('month')}, ' | ', {EVIDENCE_SQL}) FROM (
  SELECT *, coalesce(z_score, 0.0) AS z FROM enriched WHERE is_anomaly ORDER BY z, meeting_id LIMIT 20)"""]
    for section, p in ((4, "p0"), (5, "p1")):
        out.append(f"""SELECT {section}, CAST(row_number() OVER (ORDER BY z DESC, meeting_id) AS INTEGER), concat('  ', {_s(ACCOUNT_SQL)}, ' | ',
    {_s('category')}, ' | ', {_s('month')}, ' | ', {REASONING_SQL}, CASE WHEN has_pagerduty THEN ' [PagerDuty fired]' ELSE '' END) FROM (
  SELECT *, coalesce(z_score, 0.0) AS z FROM enriched WHERE escalation_priority = {q(p)} ORDER BY z DESC, meeting_id LIMIT 15)""")
    return with_enriched("\nUNION ALL ".join(f"({x})" for x in out))


register("d26_briefing_lines", _briefing_sql())(lambda spark, sf: briefing_lines(enriched(spark, sf)))


# --- D-02 on the meetings' flat text fields, with an oracle ---------------------------------------
def _meeting_text_redaction(spark, sf):
    e = meetings_raw(spark, sf).select("meeting_id", "title", "summary")
    return RD.redact_record(e, ["title", "summary"]).select("meeting_id", "title", "summary", "n_pii_redacted")


register("d02b_redact_meeting_text",
         "WITH " + meetings_ctes() + ",\n" + redaction_ctes("meetings_plain", "meeting_id", "title", "rt") + ",\n"
         + redaction_ctes("meetings_plain", "meeting_id", "summary", "rs")
         + f"\nSELECT a.source_id AS meeting_id, a.t{_NP} AS title, b.t{_NP} AS summary, "
         + f"CAST(a.n{_NP} + b.n{_NP} AS INTEGER) AS n_pii_redacted FROM rt{_NP} a JOIN rs{_NP} b ON a.source_id = b.source_id")(
    _meeting_text_redaction)
