"""Per-meeting column functions on small hand-made rows (edge cases of the rules)."""
import json

from pyspark.sql import functions as F

from colloquy.functions import accounts, classify, issues, routing, sentiment

MOMENTS = "array<struct<text:string,type:string>>"


def one(spark, col, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_call_type_case_sensitive_and_null(spark):
    got = one(spark, classify.call_type(F.col("t")), "t string",
              [("Support Case #1",), ("support case #1",), ("Aegis / Acme",), ("aegis / acme",), ("",), (None,)])
    assert got == ["support", "internal", "external", "internal", "internal", "internal"]


def test_category_levels_first_match_and_substrings(spark):
    rows = [("support case #9", []), ("War Room 7", ["renewal"]), ("x", ["rapid growth"]), ("x", ["misc", "outage"]),
            ("x", ["general", "misc"]), ("x", ["outage", "compliance"]), (None, None)]
    got = spark.createDataFrame(rows, "t string, topics array<string>").select(
        classify.category(F.col("t"), F.col("topics")), classify.category_level(F.col("t"), F.col("topics"))).collect()
    assert [tuple(r) for r in got] == [
        ("Technical Support", 1), ("Incident Response", 1), ("Technical Support", 2),  # 'api' inside 'rapid'
        ("Incident Response", 3), ("Other", 0), ("Incident Response", 2), ("Other", 0)]


def test_topic_categories_and_string_topics(spark):
    df = spark.createDataFrame([("billing, overage ,, invoice",), ("",)], "s string")
    tc = classify.topic_categories(classify.topics_from_string(F.col("s")))
    got = [(r[0], r[1]) for r in df.select(tc["primary"], tc["all"]).collect()]
    assert got == [("Commercial & Renewal", ["Commercial & Renewal"]), ("Other", ["Other"])]


def test_sentiment_rounding_and_null(spark):
    rows = [("support", 1.0), ("internal", 4.62), ("external", 3.01), ("unknown", 4.2), ("support", None)]
    s = sentiment.sentiment_columns(F.col("ct"), F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "ct string, x double")
           .select(s["z_score"], s["is_anomaly"], s["baseline"]).collect()]
    # (4.62 - 3.42) / 0.8 = 1.5 exactly: not anomalous (strict >)
    assert got == [(-2.42, True, 2.94), (1.5, False, 3.42), (-1.5, False, 4.21), (1.5, False, 3.0), (None, False, 2.94)]


def test_issue_extraction_stop_rule_and_titles(spark):
    km = json.dumps([{"text": "Login is SLOW for EU users", "type": "incident"},
                     {"text": "Quick question on SSO", "type": "question"}])
    rows = [("Production outage; services are down. Also degraded.", "[]"),
            ("All fine. A slow report and a minor request.", "[]"),
            ("Nothing here", km),
            ("The download failed", "[]"),
            ("Team discussed quarterly goals.", "[]")]
    df = spark.createDataFrame(rows, "s string, k string").withColumn("m", F.from_json("k", MOMENTS))
    got = df.select(issues.extract_issues(F.col("s"), F.col("m")).alias("i")).collect()
    flat = [[(x["severity"], x["title"], x["type"]) for x in r["i"]] for r in got]
    assert flat[0] == [("p0", "P0 signal: outage", "pattern_match")]
    assert flat[1] == [("p2", "P2 signal: slow", "pattern_match"), ("p3", "P3 signal: request", "pattern_match")]
    assert flat[2] == [("p2", "Login is SLOW for EU users", "incident"), ("p3", "Quick question on SSO", "question")]
    assert flat[3] == [("p0", "P0 signal: down", "pattern_match")]  # substring: 'down' in 'download'
    assert flat[4] == []


def test_routing_rules_fallbacks_and_string_boolean(spark):
    rows = [("Incident Response", "p1", 4.0, "false"), ("Other", "p3", 2.0, "true"), ("Other", "p3", 2.0, "yes"),
            ("Other", None, 3.0, "0"), ("Commercial & Renewal", "p1", 3.0, "false"), ("Other", "p0", 2.0, "false")]
    df = spark.createDataFrame(rows, "c string, s string, x double, a string")
    r = routing.route(F.col("c"), F.col("s"), F.col("x"), routing.as_bool(F.col("a")))
    got = [tuple(v) for v in df.select(r["team"], r["priority"], r["pagerduty"], r["requires_escalation"]).collect()]
    assert got == [("engineering", "p1", True, True), ("cs", "p3", False, True), ("cs", "p3", False, True),
                   ("support", "p3", False, False), ("cs", "p1", True, True), ("engineering", "p0", True, True)]


def test_accounts(spark):
    rows = [("Aegis / Acme Corp - Annual Renewal", "external"), ("Aegis / TechCorp SAML Setup", "external"),
            ("aegis /  Lower - x - y", "external"), ("Aegis / Acme", "internal"),
            ("Support Case #12 - Brightpath Commerce Billing question", "support"),
            ("Support Case #12 - Customer#001 API Timeout", "support")]
    df = spark.createDataFrame(rows, "t string, ct string")
    got = [tuple(r) for r in df.select(accounts.account_name(F.col("t"), F.col("ct")),
                                       accounts.company(F.col("t"), F.col("ct")),
                                       accounts.company_simple(F.col("t"))).collect()]
    assert got[0] == ("Acme Corp", "Acme Corp", "Acme Corp")
    assert got[1] == ("TechCorp SAML Setup", "TechCorp SAML Setup", "TechCorp SAML Setup")
    assert got[2][0] == "Lower"
    assert got[3][0] == ""
    assert got[4][1] == "Brightpath Commerce"
    assert got[5][1] == "Customer"


def test_thresholds_read_the_raw_score(spark):
    """2.996 is below 3.0 and 2.496 below 2.5, though their hundredths are not."""
    from colloquy.functions.flags import risk_score
    from colloquy.functions.sentiment import hundredths, micros
    from colloquy.operators import reports as R
    rows = [("a", "2026-03", "external", "c", 2.996), ("b", "2026-03", "external", "c", 3.0), ("d", "2026-03", "external", "c", 2.496)]
    e = spark.createDataFrame(rows, "meeting_id string, month string, call_type string, company string, sentiment_score double")
    e = e.withColumn("score_h", hundredths(F.col("sentiment_score")))
    assert R.month_breakdown(e, "2026-03", "call_type").first()["n_below_3"] == 2
    got = e.select("meeting_id", risk_score(micros(F.col("sentiment_score")), F.lit(None).cast("double"), F.lit(False)).alias("r")).collect()
    assert {r["meeting_id"]: r["r"] for r in got} == {"a": 25, "b": 10, "d": 40}
