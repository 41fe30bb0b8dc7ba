"""Column -> Column building blocks.  Everything here is a Catalyst expression
(no Python UDFs), so it stays inside whole-stage codegen."""

from colloquy.functions.classify import (  # noqa: F401
    call_type, category, category_level, l3_category, topic_categories,
    topics_from_string, any_keyword,
)
from colloquy.functions.sentiment import sentiment_columns, hundredths, round_half_up  # noqa: F401
from colloquy.functions.issues import extract_issues, top_severity  # noqa: F401
from colloquy.functions.routing import route, notebook_team  # noqa: F401
from colloquy.functions.accounts import (  # noqa: F401
    account_name, account_from_title, company, company_simple,
)


def _tool_registry():
    from colloquy.functions import flags as _flags
    from colloquy.functions import redact as _redact
    return {
        "classify_call_type": call_type,
        "classify_category": topic_categories,
        "classify_meeting_category": category,
        "topic_categories": topic_categories,
        "analyze_sentiment": sentiment_columns,
        "extract_issues": extract_issues,
        "top_severity": top_severity,
        "route_escalation": route,
        "account_name": account_name,
        "company": company,
        "feature_gap": _flags.feature_gap_rule,
        "outage_related": _flags.outage_related,
        "redact": _redact.redact,
    }


def tool(name: str):
    """X-01: tool registry — name -> Column function; an unknown name is an error."""
    reg = _tool_registry()
    if name not in reg:
        raise ValueError(f"Unknown function: {name!r}")
    return reg[name]
