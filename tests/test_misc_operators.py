"""Briefing lines, usage cost, tool registry, all-parts reader + sanitized write."""
import json
import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions import tool
from colloquy.operators import sinks as SK
from colloquy.operators.briefing import briefing_lines
from colloquy.operators.records import enriched
from colloquy.operators.usage import usage_cost
from colloquy.sources.raw_json import read_all_parts
from tests.conftest import SF_SMALL


def test_briefing_sections_and_caps(spark):
    lines = briefing_lines(enriched(spark, SF_SMALL)).collect()
    per = {}
    for r in lines:
        per.setdefault(r["section"], []).append(r)
    assert len(per[1]) == 1 and "Total Meetings Processed:  1500" in per[1][0]["line"]
    assert len(per[2]) == 3 and len(per[3]) == 20 and len(per[4]) <= 15 and len(per[5]) <= 15
    assert all("→ routed to" in r["line"] for r in per[4])


def test_usage_cost(spark):
    usage = spark.createDataFrame([("model-a", 1000, 500), ("model-a", 0, 1000), ("other", 1_000_000, 0)],
                                  "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("model-a", 1.0, 2.0)], "model string, input_per_million double, output_per_million double")
    got = {r["model"]: (r["calls"], r["cost_usd"]) for r in usage_cost(usage, prices).collect()}
    assert got == {"model-a": (2, 0.004), "other": (1, 3.0)}


def test_tool_registry(spark):
    assert tool("classify_call_type") is not None
    with pytest.raises(ValueError):
        tool("nope")


def test_all_parts_and_sanitized_write(spark, scratch):
    root = os.path.join(scratch, "raw")
    for mid, email in (("m1", "a@example.com"), ("m2", None)):
        d = os.path.join(root, mid)
        os.makedirs(d)
        with open(os.path.join(d, "meeting-info.json"), "w") as f:
            json.dump({"title": f"Aegis / Acme - sync {email or ''}", "startTime": "2026-02-03T10:00:00Z"}, f)
        if email:
            with open(os.path.join(d, "transcript.json"), "w") as f:
                json.dump({"segments": [{"text": f"mail me at {email}"}]}, f)
    parts = read_all_parts(spark, root)
    assert parts.count() == 2 and parts.filter(F.col("transcript").isNull()).count() == 1
    out = os.path.join(scratch, "processed")
    SK.write_sanitized(parts, out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))
    assert "a@example.com" not in text and "[EMAIL_" in text
