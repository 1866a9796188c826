"""DuckDB SQL for the queries that SQL can express: written from their contracts, brute force, not from the plans."""

from __future__ import annotations

from spanloom.llm import licenses, mixing, quality, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def quality_sql() -> str:
    """Base counts, then quartiles of rounded values for each language and source, then the fences."""
    measures = {
        "symbols_a_word": "n_symbols / greatest(n_words, 1)::DOUBLE",
        "dup_lines_a_line": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
        "repeats_a_word": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
        "stutters_a_word": "n_stutters / greatest(n_words, 1)::DOUBLE",
        "word_length": "word_chars / greatest(n_words, 1)::DOUBLE",
    }
    unit, bits, n = quality.UNIT, quality.SKETCH_BITS, quality.WINDOW
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST(floor({x} * {unit}) AS BIGINT) AS x FROM passed" for m, x in measures.items())
    quartiles = ", ".join(f"min(value) FILTER (WHERE measure = '{m}' AND up >= ceil({p} * total)) / {unit}::DOUBLE AS {m}_{i}" for m in measures for i, p in (("q1", 0.25), ("q3", 0.75)))
    fits = []
    for m, (fence, slack, below) in quality.FENCES.items():
        spread = f"{fence} * greatest({m}_q3 - {m}_q1, {slack})"
        fits.append(f"{measures[m]} <= {m}_q3 + {spread}" + (f" AND {measures[m]} >= {m}_q1 - {spread}" if below else ""))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t),
win AS (SELECT r, i, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM p WHERE i + {n - 1} <= len(w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(*) AS c FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM twice) GROUP BY r),
stutter AS (SELECT r, count(*) AS c FROM p WHERE i > 1 AND w[i] = w[i-1] GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT t.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  CAST(coalesce(covered.c, 0) AS BIGINT) AS n_repeat_words, coalesce(stutter.c, 0) AS n_stutters
  FROM t JOIN lines ON t.r = lines.r LEFT JOIN covered ON t.r = covered.r LEFT JOIN stutter ON t.r = stutter.r),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
passed AS (SELECT * FROM b WHERE NOT base_failed),
v AS (SELECT lang, source, measure, x - x % CAST(pow(2, greatest(length(bin(x)) - {bits}, 0)) AS BIGINT) AS value FROM ({values})),
h AS (SELECT lang, source, measure, value, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY value) AS up, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM h),
q AS (SELECT lang, source, {quartiles} FROM s GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(fits)} AS kept
FROM b LEFT JOIN q ON b.lang IS NOT DISTINCT FROM q.lang AND b.source IS NOT DISTINCT FROM q.source"""


#: All pairs of different texts that share a shingle, then closures over the links.
NEAR = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
n AS (SELECT min(r) AS node, array_to_string(w, ' ') AS k, any_value(w) AS w, count(*) AS copies FROM t WHERE len(w) > 0 AND doc_id IS NOT NULL GROUP BY k),
sh AS (SELECT DISTINCT node, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n)),
sz AS (SELECT node, count(*) AS c FROM sh GROUP BY node),
pair AS (SELECT a.node AS x, b.node AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.node <> b.node GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN sz sx ON sx.node = x JOIN sz sy ON sy.node = y WHERE 5 * pair.c >= 4 * (sx.c + sy.c - pair.c)),
reach AS (SELECT node AS x, node AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT reach.x AS node, min(t.doc_id) AS class_id FROM reach JOIN n m ON m.node = reach.y JOIN t ON array_to_string(t.w, ' ') = m.k WHERE t.doc_id IS NOT NULL GROUP BY reach.x),
cnt AS (SELECT n.node, any_value(n.copies) - 1 + coalesce(sum(m.copies), 0) AS c FROM n LEFT JOIN link ON link.x = n.node LEFT JOIN n m ON m.node = link.y GROUP BY n.node)
SELECT t.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN coalesce(class_id, t.doc_id) END AS class_id, CAST(CASE WHEN t.doc_id IS NOT NULL THEN coalesce(cnt.c, 0) ELSE 0 END AS BIGINT) AS n_links
FROM t LEFT JOIN n ON n.k = array_to_string(t.w, ' ') AND t.doc_id IS NOT NULL LEFT JOIN class ON class.node = n.node LEFT JOIN cnt ON cnt.node = n.node"""

def licenses_sql() -> str:
    """Every window of every text against every template, by the shingles they share."""
    import math
    import re

    rows = []
    for number, (name, text) in enumerate(licenses.TEMPLATES):
        t = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        k = licenses.SHINGLE if len(t) >= licenses.LONG else licenses.SHORT_SHINGLE
        grams = {" ".join(t[i : i + k]) for i in range(len(t) - k + 1)}
        rows += [f"('{name}', {number}, {len(t)}, {k}, {math.ceil(licenses.CONTAIN * len(grams))}, '{g}')" for g in sorted(grams)]
    return rf"""
WITH tpl(name, id, n, k, need, g) AS (VALUES {", ".join(rows)}),
t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT r, t, unnest(range(0, len(t) - 2)) AS p FROM t),
g AS (SELECT r, p, 3 AS k, array_to_string(t[p+1:p+3], ' ') AS g FROM p UNION ALL SELECT r, p, 5, array_to_string(t[p+1:p+5], ' ') FROM p WHERE p + 5 <= len(t)),
hit AS (SELECT r, p, tpl.* FROM g JOIN tpl ON g.g = tpl.g AND g.k = tpl.k),
win AS (SELECT *, unnest([p // n, p // n - 1]) AS j FROM hit),
found AS (SELECT DISTINCT r, name FROM (SELECT r, id, name, j, need, count(DISTINCT g) AS c FROM win WHERE j >= 0 AND p >= j * n AND p + k <= j * n + 2 * n GROUP BY ALL) WHERE c >= need)
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, count(name) AS n_licenses FROM t LEFT JOIN found USING (r) GROUP BY r, doc_id"""


def secrets_sql() -> str:
    """Matches with their places, owners of values by different texts, and the spans that stay."""
    kinds = [(name, pattern, group, f"length(v) >= {least}") for name, pattern, group, least in secrets.KINDS]
    run = "(regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') OR length(v) >= 24 AND regexp_full_match(v, '[A-Z0-9]+') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]'))"
    digits = "list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(reverse(v)[i] AS INTEGER) > 4 THEN CAST(reverse(v)[i] AS INTEGER) * 2 - 9 ELSE CAST(reverse(v)[i] AS INTEGER) * 2 END ELSE CAST(reverse(v)[i] AS INTEGER) END)"
    kinds += [("mixed", "[A-Za-z0-9+/_-]{16,}", 0, run)]
    kinds += [("card", "[A-Za-z0-9]{13,}", 0, f"CASE WHEN regexp_full_match(v, '[0-9]{{13,19}}') THEN len(list_distinct(string_split(v, ''))) >= 3 AND list_sum({digits}) % 10 = 0 ELSE false END")]
    parts = []
    for number, (name, pattern, group, keep) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT r, {number} AS kn, '{name}' AS kind, a, a + length(m) AS b, v FROM (SELECT r, v[i] AS v, m[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT r, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, string_split_regex(text, '{quoted}') AS g, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS v FROM t WHERE regexp_matches(text, '{quoted}')))) WHERE {keep}")
    n = len(secrets.KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
s AS ({" UNION ALL ".join(parts)}),
base AS (SELECT * FROM s WHERE kn < {n}),
c AS (SELECT * FROM base UNION ALL SELECT * FROM s x WHERE kn >= {n} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.a < x.b AND x.a < b.b)),
own AS (SELECT v, t.text, min(source || chr(1) || lang) AS repository FROM c JOIN t USING (r) GROUP BY ALL),
copied AS (SELECT v FROM own GROUP BY v HAVING count(DISTINCT split_part(repository, chr(1), 1)) > {secrets.MAX_OWNERS} OR count(DISTINCT repository) > {secrets.MAX_REPOSITORIES} OR count(*) > {secrets.MAX_TEXTS}),
j AS (SELECT c.*, copied.v IS NULL AS live FROM c LEFT JOIN copied ON copied.v = c.v)
SELECT doc_id, count(*) FILTER (WHERE kn = 0) AS n_assign, count(*) FILTER (WHERE kn = 1) AS n_access, count(*) FILTER (WHERE kn = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kn) FILTER (WHERE kn < {n}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kn) FILTER (WHERE kn < {n} OR live), '') AS spans, count(*) FILTER (WHERE live) AS n_live
FROM t LEFT JOIN j USING (r) GROUP BY r, doc_id"""


def mixing_sql() -> str:
    """Targets by water level, quotas by sorted quotients, and each document's part of the circle of its shard."""
    seed, block, cap = mixing.SEED, mixing.BLOCK, mixing.MAX_REPEAT
    number = lambda text: f"CAST('0x' || md5({text})[1:12] AS BIGINT)"
    place = "cap / w, source NULLS LAST"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w, {cap}::DOUBLE * source_size AS cap FROM a),
l AS (SELECT *, ({mixing.EPOCHS}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY {place} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY {place} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY {place}) AS k FROM w),
t AS (SELECT source, source_size, docs, coalesce(least(cap, w * (SELECT arg_min(level, k) FILTER (WHERE cap / w > level) FROM l)), cap) AS target FROM l),
n AS (SELECT CAST(round(sum(target) / {block}) AS BIGINT) AS n FROM t),
q AS (SELECT source, n, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS rk FROM (SELECT source, target, n, unnest(range(0, n)) AS k FROM t, n WHERE target > 0)),
g AS (SELECT source, count(*) FILTER (WHERE rk <= n) AS quota FROM q GROUP BY source),
s AS (SELECT d.*, source_size, target, coalesce(quota, 0) AS quota, {number('ord')} % CAST(ceil(docs / {mixing.SHARD_ROWS}::DOUBLE) AS BIGINT) AS shard FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source),
h AS (SELECT source, shard, any_value(quota) AS quota, CAST(sum(size) AS BIGINT) AS line FROM s GROUP BY source, shard),
hq AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY line / (2 * k + 1)::DOUBLE DESC, shard) AS rk FROM (SELECT *, unnest(range(0, quota)) AS k FROM h WHERE line > 0)),
hg AS (SELECT source, shard, count(*) FILTER (WHERE rk <= quota) AS blocks FROM hq GROUP BY source, shard),
c AS (SELECT h.source, h.shard, line, greatest(line, 1) AS len, least(coalesce(blocks, 0) * {block}, CAST(floor({cap} * line) AS BIGINT)) AS total, {number(f"'{seed}:' || coalesce(h.source, 'null') || ':' || h.shard")} % greatest(line // {block}, 1) * {block} AS lo
 FROM h LEFT JOIN hg ON hg.source IS NOT DISTINCT FROM h.source AND hg.shard = h.shard),
p AS (SELECT s.*, c.line, c.total // c.len AS rounds, c.lo, c.lo + c.total % c.len AS hi, coalesce(sum(size) OVER (PARTITION BY s.source, s.shard ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM s JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.shard = s.shard)
SELECT doc_id, size, source_size, target, source, CAST(rounds * size + greatest(0, least(size, hi - at0) - greatest(0, lo - at0)) + greatest(0, least(size, hi - line - at0) - greatest(0, lo - line - at0)) AS BIGINT) AS taken FROM p"""


ORACLE_SQL: dict[str, str] = {
    "op2_mix": mixing_sql(),
    "op8_licenses": licenses_sql(),
    "op10_secrets": secrets_sql(),
    "op6_near": NEAR,
    "op5_quality": quality_sql(),
    "op1_substrings": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM p WHERE i + 12 <= len(w)),
f AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN f USING (g) WHERE f.first_doc < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t, count(*) AS n
         FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
}
