"""Redaction operators over DataFrames: text columns, nested records, the vault, leak check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.redact import MATCH_TYPE, java_pattern, pii_possible, placeholder, redact, unmarked
from colloquy.rules import DEFAULT_RULES, RuleSet


def redact_column(df: DataFrame, column: str, rules: RuleSet = DEFAULT_RULES, out: str | None = None,
                  count_col: str = "n_redacted") -> DataFrame:
    """Replace ``column`` (or write ``out``) with its redacted text and add the replacement count."""
    r = redact(F.col(column), rules)
    return (df.withColumn("_r", r)
            .withColumn(out or column, F.col("_r.text"))
            .withColumn(count_col, F.col("_r.n")).drop("_r"))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _no_matches() -> Column:
    return F.array().cast(MATCH_TYPE)


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType) or isinstance(dtype, T.ArrayType) and _has_text(dtype.elementType)


def _redact_value(c: Column, dtype: T.DataType, rules: RuleSet) -> Column | None:
    """struct<v, n, m>: redacted value, number of replacements, matches.  Every string leaf's
    pattern chain stands in it once, at any depth; None if there is no string leaf."""
    if isinstance(dtype, T.StringType):
        return _let(redact(c, rules, keep_matches=True),
                    lambda r: F.struct(r["text"].alias("v"), r["n"].alias("n"), r["matches"].alias("m")))
    if isinstance(dtype, T.StructType):
        parts = {f.name: x for f in dtype.fields if (x := _redact_value(c[f.name], f.dataType, rules)) is not None}
        if not parts:
            return None

        def rebuilt(s):
            value = F.struct(*[(s[f.name]["v"] if f.name in parts else c[f.name]).alias(f.name) for f in dtype.fields])
            n, m = F.lit(0), _no_matches()
            for name in parts:
                n, m = n + s[name]["n"], F.concat(m, s[name]["m"])
            return F.struct(F.when(c.isNotNull(), value).alias("v"), n.alias("n"), m.alias("m"))

        return _let(F.struct(*[x.alias(name) for name, x in parts.items()]), rebuilt)
    if isinstance(dtype, T.ArrayType):
        if not _has_text(dtype.elementType):
            return None
        done = _let(F.transform(c, lambda x: _redact_value(x, dtype.elementType, rules)), lambda s: F.struct(
            F.transform(s, lambda x: x["v"]).alias("v"),
            F.coalesce(F.aggregate(s, F.lit(0), lambda acc, x: acc + x["n"]), F.lit(0)).alias("n"),
            F.coalesce(F.flatten(F.transform(s, lambda x: x["m"])), _no_matches()).alias("m")))
        leaves = _leaves(c, dtype)
        if leaves is None:
            return done
        untouched = F.struct(c.alias("v"), F.lit(0).alias("n"), _no_matches().alias("m"))
        return F.when(unmarked(leaves, rules), untouched).otherwise(done)
    return None


def _leaves(c: Column, dtype: T.ArrayType) -> Column | None:
    """The string leaves of an array of strings, or of structs with no deeper leaves, as one array."""
    if isinstance(dtype.elementType, T.StringType):
        return c
    if isinstance(dtype.elementType, T.StructType):
        texts = [f for f in dtype.elementType.fields if _has_text(f.dataType)]
        if all(isinstance(f.dataType, T.StringType) for f in texts):
            return F.concat(*[c[f.name] for f in texts])
    return None


_EXPR_CACHE: dict = {}


def _redacted(df: DataFrame, column: str, dtype: T.DataType, rules: RuleSet) -> Column:
    """The expression of one column, built once per application: the pattern chains take
    thousands of driver-to-JVM calls to assemble."""
    key = (df.sparkSession.sparkContext.applicationId, column, dtype.json(), repr(rules))
    if key not in _EXPR_CACHE:
        _EXPR_CACHE[key] = _redact_value(F.col(column), dtype, rules)
    return _EXPR_CACHE[key]


def redact_record(df: DataFrame, columns: list | None = None, rules: RuleSet = DEFAULT_RULES,
                  count_col: str = "n_pii_redacted", match_col: str | None = None) -> DataFrame:
    """Redact every string leaf of the given (nested) columns; add the total count and, if
    ``match_col`` is given, the matches of all leaves."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    done = {c: _redacted(df, c, schema[c], rules) for c in columns or df.columns if _has_text(schema[c])}
    total, matches = F.lit(0), _no_matches()
    for c in done:
        total, matches = total + F.col(f"_r_{c}.n"), F.concat(matches, F.col(f"_r_{c}.m"))
    out = df.withColumns({f"_r_{c}": x for c, x in done.items()})
    more = {match_col: matches} if match_col else {}
    return out.withColumns({**{c: F.col(f"_r_{c}.v") for c in done}, count_col: total, **more}).drop(*[f"_r_{c}" for c in done])


def match_rows(df: DataFrame, id_col: str, column: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """One row per match: (id, pidx, pos, entity_type, original, placeholder)."""
    r = redact(F.col(column), rules, keep_matches=True)
    return _match_columns(df.select(F.col(id_col).alias("source_id"), F.explode(r["matches"]).alias("m")))


def _match_columns(m: DataFrame) -> DataFrame:
    return m.select("source_id", "m.pidx", "m.pos", "m.entity_type", "m.original",
                    F.concat(F.lit("["), F.col("m.entity_type"), F.lit("_"),
                             F.substring(F.md5(F.lower("m.original")), 1, 6), F.lit("]")).alias("placeholder"))


def pii_vault(matches: DataFrame) -> DataFrame:
    """Upsert semantics: one row per placeholder; the last write (highest source id,
    pattern, position) wins.  ``max_by`` aggregates partially, so a placeholder that
    occurs in a third of all documents is combined map-side, not in one task."""
    order = F.struct("source_id", "pidx", "pos", "original")
    return matches.groupBy("placeholder").agg(
        F.max_by("original", order).alias("original"),
        F.max_by("entity_type", order).alias("entity_type"),
        F.max_by("source_id", order).alias("source_id"),
        F.count(F.lit(1)).alias("n_matches"))


def leak_check(df: DataFrame, id_col: str, column: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """E-03: matches of the raw text that still occur verbatim in the redacted text."""
    r = redact(F.col(column), rules, keep_matches=True)
    return (df.select(F.col(id_col).alias("source_id"), r.alias("r"))
            .select("source_id", F.col("r.text").alias("text"), F.explode("r.matches").alias("m"))
            .filter(F.col("text").contains(F.col("m.original")))
            .select("source_id", F.col("m.original").alias("original")))


def residue(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Matches that any pattern has in ``text``."""
    left = F.lit(0)
    for _, p in rules.pii_patterns:
        left = left + F.coalesce(F.size(F.regexp_extract_all(text, F.lit(java_pattern(p)), 0)), F.lit(0))
    return F.when(pii_possible(text, rules), left).otherwise(F.lit(0)).cast("long")


def leak_report(df: DataFrame, column: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """E-03: texts, redacted texts, replacements, and matches that any pattern still has in the output."""
    r = df.select(redact(F.col(column), rules).alias("r")).select("r.text", "r.n")
    return r.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("n") > 0).alias("n_redacted"),
                 F.sum(F.col("n").cast("long")).alias("n_matches"), F.sum(residue(F.col("text"), rules)).alias("n_left"))


def reveal(redacted: DataFrame, id_col: str, column: str, vault: DataFrame) -> DataFrame:
    """J-12: vault reverse lookup — replace placeholders by originals (per row, via
    explode + join on placeholder + fold).  The vault side is joined, not broadcast:
    it grows with the data."""
    ph = redacted.select(F.col(id_col).alias("_id"),
                         F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\[[A-Z_]+_[0-9a-f]{6}\]"), 0)))
                         .alias("placeholder"))
    pairs = (ph.join(vault.select("placeholder", "original"), "placeholder")
             .groupBy("_id").agg(F.collect_list(F.struct("placeholder", "original")).alias("pairs")))
    return (redacted.join(pairs, redacted[id_col] == pairs["_id"], "left")
            .withColumn(column, F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<placeholder:string,original:string>>")),
                                            F.col(column), lambda acc, p: F.replace(acc, p["placeholder"], p["original"])))
            .drop("_id", "pairs"))


__all__ = ["redact_column", "redact_record", "match_rows", "pii_vault", "leak_check", "leak_report", "reveal", "placeholder"]


MEETING_TEXT_COLUMNS = ["title", "summary", "attendees", "topics", "key_moments", "action_items"]
MATCH_COLUMN = "pii_matches"


def sanitize(meetings: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Ingestion firewall: every string leaf of the meetings redacted in one pass, with the
    replacement count (``n_pii_redacted``) and the matches (``MATCH_COLUMN``) of all leaves."""
    return redact_record(meetings, [c for c in MEETING_TEXT_COLUMNS if c in meetings.columns], rules, match_col=MATCH_COLUMN)


def matches_of(sanitized: DataFrame) -> DataFrame:
    """One row per match of the sanitized meetings, in the form of :func:`match_rows`."""
    return _match_columns(sanitized.select(F.col("meeting_id").alias("source_id"), F.explode(MATCH_COLUMN).alias("m")))


def vault_rows(sanitized: DataFrame) -> DataFrame:
    """(source_id, placeholder, entity_type, original, n_matches): what :func:`reveal_record` needs.

    A placeholder holds 24 bits of a hash, so among many meetings two originals share one; per
    meeting that is as good as impossible, so the row's key has the meeting too.  Of originals
    that differ in case only, the last in (pattern, position) order is kept."""
    m = matches_of(sanitized)
    last = F.max(F.struct("pidx", "pos", "original", "entity_type"))
    return m.groupBy("source_id", "placeholder").agg(last.alias("_l"), F.count(F.lit(1)).alias("n_matches")).select(
        "source_id", "placeholder", "_l.entity_type", "_l.original", "n_matches")


PLACEHOLDER = r"\[[A-Z_]+_[0-9a-f]{6}\]"


def _reveal_value(c: Column, dtype: T.DataType, known: Column) -> Column | None:
    """``c`` with the placeholders of every string leaf replaced from the map ``known``."""
    if isinstance(dtype, T.StringType):
        marks = F.array_distinct(F.regexp_extract_all(c, F.lit(PLACEHOLDER), 0))
        return F.when(c.isNotNull(), F.aggregate(marks, c, lambda acc, m: F.coalesce(F.replace(acc, m, known[m]), acc)))
    if isinstance(dtype, T.StructType):
        parts = {f.name: _reveal_value(c[f.name], f.dataType, known) for f in dtype.fields if _has_text(f.dataType)}
        if not parts:
            return None
        return F.when(c.isNotNull(), F.struct(*[parts.get(f.name, c[f.name]).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType) and _has_text(dtype.elementType):
        return F.transform(c, lambda x: _reveal_value(x, dtype.elementType, known))
    return None


def reveal_record(redacted: DataFrame, vault: DataFrame, columns: list | None = None, id_col: str = "meeting_id") -> DataFrame:
    """J-12 for nested columns: every string leaf of ``columns`` with its originals, from the rows of
    :func:`vault_rows`.  A meeting's rows of the vault are gathered once (as many as it has
    placeholders) and joined on its id; placeholders without a row stay."""
    schema = {f.name: f.dataType for f in redacted.schema.fields}
    columns = [c for c in columns or redacted.columns if c != id_col and _has_text(schema[c])]
    known = vault.groupBy(F.col("source_id").alias("_source")).agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_known"))
    out = redacted.join(known, F.col(id_col) == F.col("_source"), "left")
    new = {c: F.when(F.col("_known").isNull(), F.col(c)).otherwise(_reveal_value(F.col(c), schema[c], F.col("_known"))) for c in columns}
    return out.withColumns(new).drop("_source", "_known")


def sanitize_meetings(meetings: DataFrame, rules: RuleSet = DEFAULT_RULES) -> tuple:
    """(sanitized meetings, match rows) of one pass over the leaves."""
    redacted = sanitize(meetings, rules)
    return redacted.drop(MATCH_COLUMN), matches_of(redacted)
