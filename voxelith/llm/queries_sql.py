"""DuckDB texts that return the same rows as the queries. They share no code with the operators."""

#: Sizes, totals, targets and hash order of op2, over a table or view `{docs}`.
MIX = r"""
docs_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS place
  FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs_ GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM ranked),
steps AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE)
              ELSE weight * (SELECT max(level) FROM steps WHERE level * weight < cap) END AS target
  FROM steps),
based AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM goals),
places AS (SELECT source, place, sum(size) AS words FROM docs_ GROUP BY source, place),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
again AS (
  SELECT r.source, r.place
  FROM running r JOIN based b ON r.source IS NOT DISTINCT FROM b.source
  WHERE r.upto <= target - base * source_size
     OR (r.upto - words <= target - base * source_size AND 2 * (target - base * source_size - (r.upto - words)) >= words)),
mix AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target,
         CAST(b.base + CASE WHEN a.place IS NULL THEN 0 ELSE 1 END AS INTEGER) AS copies
  FROM docs_ d JOIN based b ON d.source IS NOT DISTINCT FROM b.source
  LEFT JOIN again a ON d.source IS NOT DISTINCT FROM a.source AND d.place = a.place AND b.target > b.base * b.source_size)
"""

OP2 = "WITH " + MIX.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mix"

OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS seen FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(w.doc_id, m.least_), w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON w.doc_id = s.doc_id
LEFT JOIN (SELECT doc_id, min(seen) AS least_ FROM reach GROUP BY doc_id) m ON w.doc_id = m.doc_id
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
firsts AS (
  SELECT line, min(ROW(doc_id, line_no)) AS first_, length(line) AS n FROM lines WHERE length(line) >= 20 GROUP BY line),
cuts AS (
  SELECT line, first_, unnest(range(1, n + 1)) AS i FROM firsts),
forms AS (SELECT line, first_, i, substr(line, 1, i - 1) || substr(line, i + 1) AS form FROM cuts),
near AS (
  SELECT a.line, b.first_ AS other FROM forms a JOIN firsts b ON a.form = b.line
  UNION SELECT b.line, a.first_ FROM forms a JOIN firsts b ON a.form = b.line
  UNION SELECT a.line, b.first_ FROM forms a JOIN forms b ON a.form = b.form AND a.i = b.i AND a.line <> b.line),
bounds AS (
  SELECT f.line, least(f.first_, coalesce(min(n.other), f.first_)) AS earliest FROM firsts f LEFT JOIN near n ON f.line = n.line GROUP BY f.line, f.first_),
marked AS (
  SELECT l.doc_id, l.line, l.line_no, coalesce(ROW(l.doc_id, l.line_no) > b.earliest, false) AS gone FROM lines l LEFT JOIN bounds b ON l.line = b.line),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""

OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut),
roles AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM roles
"""


def _codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The text of op12: one step for each round, comparing every part with every entry of its codebook."""
    square = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, unnest(range({parts})) AS t(p)),
book0 AS (SELECT p, CAST(r - 1 AS INTEGER) AS e, x AS c FROM parts WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
own{k} AS MATERIALIZED (SELECT r, p, min(ROW({square}, e)) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (
  SELECT p, e, i, sum(x[i]) AS total, count(*) AS n
  FROM (SELECT o.p, o.best[2] AS e, x, unnest(range(1, len(x) + 1)) AS i FROM own{k} o JOIN parts q ON o.r = q.r AND o.p = q.p) GROUP BY p, e, i),
book{k + 1} AS (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c
  FROM book{k} b LEFT JOIN (SELECT p, e, list(CAST((total - ((total % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY p, e) s
       ON b.p = s.p AND b.e = s.e)""")
    return "WITH " + ",".join(steps) + f""",
codes AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM own{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


OP12 = _codes(8, 16, 6, 4096)
