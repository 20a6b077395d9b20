"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from lagweave.llm import license_scan, quality


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _license_sql() -> str:
    """Every place of every phrase by plain search for its words one after the other."""
    targets = license_scan.targets_of(license_scan.TEMPLATES, license_scan.BASE_PHRASES, license_scan.MIN_SCORE)
    heads = _values((k, label, len(keys), keys[0][0], keys[0][1], least, base) for k, (label, _, keys, least, base) in enumerate(targets))
    parts = _values((k, q, w) for k, t in enumerate(targets) for q, w in enumerate(t[1]))
    keys = _values((k, q, w) for k, t in enumerate(targets) for q, w in t[2])
    return f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
          FROM documents),
        head(k, label, n, q0, w0, least, base) AS (VALUES {heads}),
        part(k, q, w) AS (VALUES {parts}),
        must(k, q, w) AS (VALUES {keys}),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
        lw AS (SELECT * FROM w WHERE w IN (SELECT w FROM part)),
        idf AS (
          SELECT v.w, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT lw.r) + 1)) + 1e-6 AS idf
          FROM (SELECT DISTINCT w FROM part) v LEFT JOIN lw ON lw.w = v.w GROUP BY v.w),
        c AS (SELECT h.k, lw.r, lw.i - h.q0 AS s FROM lw JOIN head h ON lw.w = h.w0),
        v AS (
          SELECT c.k, c.r, c.s FROM c JOIN must m ON m.k = c.k JOIN lw ON lw.r = c.r AND lw.i = c.s + m.q AND lw.w = m.w
          JOIN head h ON h.k = c.k GROUP BY c.k, c.r, c.s, h.n HAVING count(*) = h.n),
        m AS (
          SELECT v.k, v.r, v.s, coalesce(sum(idf.idf) FILTER (lw.w IS NOT NULL), 0) / sum(idf.idf) AS score
          FROM v JOIN part p ON p.k = v.k JOIN idf ON idf.w = p.w LEFT JOIN lw ON lw.r = v.r AND lw.i = v.s + p.q AND lw.w = p.w GROUP BY ALL),
        f AS (SELECT m.r, m.s, h.label, h.base, CASE WHEN h.base THEN 1.0 ELSE m.score END AS score FROM m JOIN head h ON h.k = m.k WHERE h.base OR m.score >= h.least - 1e-9)
        SELECT d.doc_id, any_value(len(d.ws)) AS n_words, count(f.s) FILTER (f.base) AS n_base,
               min(f.s) FILTER (f.base) AS first_word, max(f.s) FILTER (f.base) AS last_word,
               coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
               coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels, round(least(1.0, coalesce(max(f.score), 0)), 6) AS score
        FROM d LEFT JOIN f ON f.r = d.r GROUP BY d.r, d.doc_id"""


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
          FROM documents),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
        p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(5)) AS k) WHERE c.n > 1 GROUP BY r),
        m AS (
          SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({stops}))) AS stops
          FROM d LEFT JOIN p ON p.r = d.r),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols::DOUBLE / n_words > 0.3 OR (n_words >= 20 AND (word_chars::DOUBLE / n_words < 2 OR word_chars::DOUBLE / n_words > 15))
                    OR (n_words >= 40 AND (stops::DOUBLE / n_words < 0.02 OR n_dup_lines::DOUBLE / n_lines > 0.5))) AS kept
        FROM b"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        w AS (SELECT doc_id, k, i AS a, lead(i, 2) OVER o AS z, line AS l1, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        f AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, k) AS nth FROM w WHERE l3 IS NOT NULL),
        x AS (SELECT l.doc_id, l.i, l.line, EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.nth > 1 AND l.i BETWEEN f.a AND f.z) AS gone FROM l)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
        FROM x GROUP BY doc_id""",
    "op6_ngram_jaccard": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
          FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.both >= 75 * (x.n + y.n - i.both)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_license_scan": _license_sql(),
    "op9_quality_rules": _quality_sql(),
}
