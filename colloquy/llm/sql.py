"""DuckDB SQL of the queries that SQL can express, written from the contracts.

Without SQL: op5 and op13 (trained models), op6 (byte pair merges), op8 (learnt automata), op9
(its draws are a hash that DuckDB lacks) and op11 (maximal runs of all periods).
"""

from __future__ import annotations

from colloquy.llm import centroids, jaccard, licenses, quality

_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))

OP1 = f"""
WITH files AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                      concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), CAST(doc_id AS VARCHAR)) AS path FROM documents),
templates(no, name, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT no, t, count(*) AS k FROM (SELECT no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM templates) GROUP BY no, t),
vocab AS (SELECT DISTINCT t FROM tw),
n AS (SELECT count(*) AS n FROM files),
lines AS (SELECT rid, row_number() OVER () AS line, regexp_extract_all(lower(x), '[a-z0-9]+') AS ts
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM files)),
lw AS (SELECT rid, line, t, count(*) AS k FROM (SELECT rid, line, unnest(ts) AS t FROM lines) GROUP BY rid, line, t),
idf AS (SELECT t, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS w
        FROM vocab LEFT JOIN (SELECT t, count(DISTINCT rid) AS df FROM lw SEMI JOIN vocab USING (t) GROUP BY t) USING (t), n),
unseen AS (SELECT ln(1.0 + n) + 1 AS u FROM n),
tn AS (SELECT no, sqrt(sum((k * w) ** 2)) AS norm FROM tw JOIN idf USING (t) GROUP BY no),
fw AS (SELECT rid, t, sum(k) AS k FROM lw GROUP BY rid, t),
ln_ AS (SELECT rid, line, sqrt(sum((k * coalesce(w, u)) ** 2)) AS norm FROM lw LEFT JOIN idf USING (t), unseen GROUP BY rid, line),
fn AS (SELECT rid, sqrt(sum((k * coalesce(w, u)) ** 2)) AS norm FROM fw LEFT JOIN idf USING (t), unseen GROUP BY rid),
lc AS (SELECT rid, line, no, round(d / (ln_.norm * tn.norm), 9) AS c
       FROM (SELECT rid, line, no, sum(lw.k * w * tw.k * w) AS d FROM lw JOIN tw USING (t) JOIN idf USING (t) GROUP BY rid, line, no)
       JOIN ln_ USING (rid, line) JOIN tn USING (no)),
fc AS (SELECT rid, no, round(d / (fn.norm * tn.norm), 9) AS c
       FROM (SELECT rid, no, sum(fw.k * w * tw.k * w) AS d FROM fw JOIN tw USING (t) JOIN idf USING (t) GROUP BY rid, no)
       JOIN fn USING (rid) JOIN tn USING (no)),
own AS (SELECT rid, no, c FROM lc WHERE c >= {licenses.HEADER}
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY c DESC, line, no) = 1),
whole AS (SELECT rid, no, c FROM fc SEMI JOIN own USING (rid) WHERE c >= {licenses.WHOLE}
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY c DESC, no) = 1),
dirs AS (SELECT rid, regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
given AS (SELECT dir AS from_dir, no, c FROM whole JOIN dirs USING (rid) JOIN files USING (rid)
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, doc_id) = 1),
up AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS from_dir
       FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM dirs))),
near AS (SELECT dir, from_dir, depth, no, c FROM up JOIN given USING (from_dir)
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, templates.name AS license, round(coalesce(own.c, near.c), 6) AS cosine,
       CASE WHEN own.no IS NOT NULL THEN 'header' WHEN near.no IS NOT NULL THEN 'directory' END AS origin,
       CASE WHEN own.no IS NULL THEN near.from_dir END AS from_dir,
       CAST(CASE WHEN own.no IS NULL THEN near.depth END AS INTEGER) AS depth
FROM files JOIN dirs USING (rid) LEFT JOIN own USING (rid) LEFT JOIN near USING (dir)
LEFT JOIN templates ON templates.no = coalesce(own.no, near.no)"""

OP2 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, pos, b[pos:pos + 99] AS x FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 98)) AS pos FROM d)),
later AS (SELECT rid, pos FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY rid, pos) > 1),
runs AS (SELECT rid, min(pos) AS a, max(pos) + 99 AS z
         FROM (SELECT rid, pos, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS run
               FROM (SELECT rid, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS fresh FROM later))
         GROUP BY rid, run),
ends AS (SELECT rid, a, z FROM runs UNION ALL SELECT rid, octet_length(b) + 1, octet_length(b) FROM d),
kept AS (SELECT rid, a, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a, z), 0) + 1 AS begin FROM ends),
texts AS (SELECT rid, string_agg(CASE WHEN a > begin THEN hex(b[begin:a - 1]) ELSE '' END, '' ORDER BY begin) AS h FROM kept JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM d JOIN texts USING (rid) LEFT JOIN (SELECT rid, sum(z - a + 1) AS gone, count(*) AS n FROM runs GROUP BY rid) USING (rid)"""

_OP3_WORDS = f"regexp_extract_all({_LOWER.format('''coalesce(text, '')''')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP3_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_OP3_WORDS} AS ws FROM benchmark),
wi AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[pos:pos + 9], ' ') AS x
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS pos FROM i WHERE len(ws) > 0)),
wd AS (SELECT rid, pos, size, array_to_string(ws[pos:pos + size - 1], ' ') AS x
       FROM (SELECT rid, size, ws, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM wi))),
found AS (SELECT DISTINCT rid, pos, size, item FROM wd JOIN wi USING (size, x)),
hit AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(pos, pos + size)) AS w FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(trim(coalesce(url, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS url
           FROM pages),
u AS (SELECT page_id, html, regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1) AS site,
             regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^#]*)', 1) AS rest FROM p),
h AS (SELECT page_id, html, rest, regexp_replace(string_split(regexp_replace(site, '^.*@', ''), ':')[1], '^www[.]', '') AS host FROM u),
k AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS sha,
             CASE WHEN host <> '' OR rest <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
                  || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE '' END AS url_key,
             strftime(TIMESTAMP '2020-01-01' + to_seconds(coalesce(page_id, 0) % 2147483648), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM h)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(sha, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
       row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) - 1 AS position, url_key, captured_at
FROM k"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS ws FROM documents),
l AS (SELECT rid, source, text, x, len(ws) AS n, lower(array_to_string(ws, ' ')) AS k
      FROM (SELECT rid, source, text, x, regexp_extract_all(x, '{_SPACE_WORD}') AS ws
            FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS x FROM d)) WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM l GROUP BY rid),
g AS (SELECT rid, pos, array_to_string(ws[pos:pos + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d)),
rep AS (SELECT rid, count(DISTINCT w) AS n
        FROM (SELECT rid, unnest(range(pos, pos + 5)) AS w FROM (SELECT rid, pos FROM g QUALIFY count(*) OVER (PARTITION BY rid, x) > 1)) GROUP BY rid),
often AS (SELECT source, k FROM l GROUP BY source, k HAVING count(DISTINCT text) > {quality.MAX_DOCS}),
gone AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM l SEMI JOIN often ON l.k = often.k AND l.source IS NOT DISTINCT FROM often.source GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND n_words - n_removed_words >= {quality.MIN_WORDS}
           AND n_words - n_removed_words >= {quality.MIN_LEFT} * n_words AS kept, n_removed_words
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM m)"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00\\x20\\x09-\\x0D]+') AS ws
                     FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[pos:pos + {jaccard.SHINGLE - 1}], ' ') AS x
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {jaccard.SHINGLE - 2}, 2))) AS pos FROM d WHERE len(ws) > 0 AND doc_id IS NOT NULL)),
sets AS (SELECT rid, sha256(string_agg(x, chr(10) ORDER BY x)) AS key, count(*) AS size FROM s GROUP BY rid),
reps AS (SELECT key, min(rid) AS rid, any_value(size) AS size, count(*) AS copies, min(doc_id) AS low FROM sets JOIN d USING (rid) GROUP BY key),
rs AS (SELECT rid, size, x FROM s JOIN reps USING (rid)),
pairs AS (SELECT a.rid AS u, b.rid AS v FROM rs a JOIN rs b ON a.x = b.x AND a.rid < b.rid
              AND {jaccard.DEN} * a.size >= {jaccard.NUM} * b.size AND {jaccard.DEN} * b.size >= {jaccard.NUM} * a.size
          GROUP BY a.rid, b.rid, a.size, b.size HAVING {jaccard.DEN} * count(*) >= {jaccard.NUM} * (a.size + b.size - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT rid AS u, rid AS v FROM reps UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
class AS (SELECT reach.u AS rid, min(low) AS class_id FROM reach JOIN reps ON reps.rid = reach.v GROUP BY reach.u),
linked AS (SELECT u AS rid, CAST(sum(copies) AS BIGINT) AS n FROM links JOIN reps ON reps.rid = links.v GROUP BY u)
SELECT doc_id, coalesce(class.class_id, doc_id) AS class_id, coalesce(linked.n, 0) + coalesce(reps.copies, 1) - 1 AS n_links
FROM d LEFT JOIN sets USING (rid) LEFT JOIN reps ON reps.key = sets.key LEFT JOIN class ON class.rid = reps.rid
LEFT JOIN linked ON linked.rid = reps.rid"""



def _rounds(k: int, rounds: int) -> str:
    """Centroids c0, c1, ... as rows (c, i, v), each from the assignment to the ones before."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT rid, c, CAST(sum((x.v - c{r}.v) * (x.v - c{r}.v)) AS BIGINT) AS d FROM x JOIN c{r} USING (i) GROUP BY rid, c) GROUP BY rid)""")
        if r < rounds:
            out.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.i, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN
    (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT a{r}.c, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
     FROM x JOIN a{r} USING (rid) GROUP BY a{r}.c, x.i)) m ON m.c = c{r}.c AND m.i = c{r}.i)""")
    return ",".join(out)


OP12 = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
    WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {centroids.DIMS}),
x AS MATERIALIZED (SELECT rid, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
    FROM e, (SELECT unnest(range(1, {centroids.DIMS + 1})) AS i)),
first AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), embedding) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS c, i, v FROM first JOIN x USING (rid) WHERE c < {centroids.CLUSTERS}),{_rounds(centroids.CLUSTERS, centroids.ROUNDS)},
digest AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{centroids.ROUNDS} GROUP BY c),
total AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a{centroids.ROUNDS} GROUP BY c)
SELECT e.vec_id, a.c AS cluster, a.d AS distance, total.own AS cluster_inertia,
       CAST((SELECT sum(own) FROM total) AS BIGINT) AS inertia, digest.sha AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN e USING (rid) JOIN digest ON digest.c = a.c JOIN total ON total.c = a.c"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1, "op2_suffix_array_dedup": OP2, "op3_benchmark_decontamination": OP3, "op4_warc": OP4,
    "op7_quality_rules": OP7, "op10_ngram_jaccard_join": OP10, "op12_centroid_clustering": OP12,
}
