"""Property tests: the Column classifiers and issue extraction agree with plain-Python
implementations of the same rules on random inputs built from rule fragments."""
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import classify, issues
from colloquy.rules import CATEGORY_TITLE_PATTERNS, SEVERITY_WORDS, TAXONOMY

KEYWORDS = sorted({k for _, ks in TAXONOMY for k in ks})
TITLE_BITS = ["Support Case #12", "support case", "Aegis / Acme", "URGENT:", "War Room", "SOC 2", "Roadmap Review",
              "Sprint Planning", "Win/Loss", "Business Review", "Q3 Planning", "Detect Outage - x", "hello", "", " - "]
WORDS = sorted({w for _, ws in SEVERITY_WORDS for w in ws}) + ["download", "fine", "escalation", "minority"]


def py_call_type(t):
    t = t or ""
    return "support" if re.match(r"^Support Case", t) else "external" if re.match(r"^Aegis /", t) else "internal"


def py_category(title, topics):
    for pat, cat in CATEGORY_TITLE_PATTERNS:
        if re.search(pat, title or "", re.IGNORECASE):
            return cat
    prim = (topics[0] if topics else "").lower()
    for cat, kws in TAXONOMY:
        if any(k in prim for k in kws):
            return cat
    allt = " ".join(topics).lower()
    for cat, kws in TAXONOMY:
        if any(k in allt for k in kws):
            return cat
    return "Other"


def py_severities(text):
    text = text.lower()
    found = []
    for sev, ws in SEVERITY_WORDS:
        if any(w in text for w in ws):
            found.append(sev)
            if sev in ("p0", "p1"):
                break
    return found


titles = st.lists(st.sampled_from(TITLE_BITS), max_size=3).map(" ".join)
topic_lists = st.lists(st.lists(st.sampled_from(KEYWORDS + ["misc", "general"]), max_size=2).map(" ".join), max_size=3)
texts = st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(titles, topic_lists, texts), min_size=200, max_size=200))
def test_classifiers_and_issues_match_python(spark, rows):
    df = spark.createDataFrame(rows, "title string, topics array<string>, s string")
    got = df.select(classify.call_type(F.col("title")), classify.category(F.col("title"), F.col("topics")),
                    issues.extract_issues(F.col("s"), F.array().cast("array<struct<text:string,type:string>>"))).collect()
    for (title, topics, s), (ct, cat, iss) in zip(rows, got):
        assert ct == py_call_type(title)
        assert cat == py_category(title, topics)
        assert [i["severity"] for i in iss] == py_severities(s)
