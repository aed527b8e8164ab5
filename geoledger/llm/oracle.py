"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from geoledger.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def _count(inside: str) -> str:
    quoted = inside.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '[{quoted}]', '', 'g'))"


def _distance(counts: str, reference: str) -> str:
    """Jensen-Shannon distance between a list of shares and the reference's list."""
    pair = f"list_transform(list_zip({counts}, {reference}), lambda z: [z[1], z[2]])"
    side = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(2 * z[{k}] / (z[1] + z[2])) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform({pair}, lambda z: {side(1)} + {side(2)})) / 2))"


_CLASSES = ", ".join(_count(p) for p in rules.CLASSES.values())
_COMMON = "CASE lang " + " ".join(
    f"WHEN '{lang}' THEN [" + ", ".join(f"len(list_filter(r, lambda x: x = '{w}'))" for w in words) + "]"
    for lang, words in rules.COMMON_WORDS.items()) + " END"

OP2 = f"""
WITH base AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, regexp_extract_all(lower(t), '\\p{{L}}+') AS r,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM base),
triple AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
           FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split WHERE len(w) >= 3)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM triple) WHERE n > 1),
covered AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY id),
figures AS (SELECT doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                   length(t) AS n_chars, len(r) AS n_runs, [{_CLASSES}] AS classes, {_COMMON} AS common,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM split LEFT JOIN covered USING (id)),
judged AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM figures),
good AS (SELECT * FROM judged WHERE NOT base_failed AND lang IN ({", ".join(f"'{x}'" for x in rules.COMMON_WORDS)})),
sums AS (SELECT lang, k, sum(classes[k]) AS c, sum(common[k]) AS d FROM good, range(1, 41) s(k) GROUP BY lang, k),
totals AS (SELECT lang, sum(n_chars) AS n_chars, sum(n_runs) AS n_runs FROM good GROUP BY lang),
reference AS (SELECT lang, list_append(list(c / n_chars ORDER BY k) FILTER (WHERE c IS NOT NULL), 1 - sum(c) / any_value(n_chars)) AS class_ref,
                     list_append(list(d / n_runs ORDER BY k) FILTER (WHERE d IS NOT NULL), 1 - sum(d) / any_value(n_runs)) AS word_ref
              FROM sums JOIN totals USING (lang) GROUP BY lang),
far AS (SELECT j.*, CASE WHEN class_ref IS NOT NULL AND n_chars >= {rules.MIN_CHARS} THEN
                 {_distance("list_transform(list_append(classes, n_chars - list_sum(classes)), lambda x: x / n_chars)", "class_ref")} END AS cd,
               CASE WHEN class_ref IS NOT NULL AND n_runs >= {rules.MIN_RUNS} THEN
                 {_distance("list_transform(list_append(common, n_runs - list_sum(common)), lambda x: x / n_runs)", "word_ref")} END AS wd
        FROM judged j LEFT JOIN reference USING (lang))
SELECT doc_id, n_words, word_chars, classes[6] AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {rules.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(wd > {rules.MAX_WORD_DISTANCE}, false) AS kept
FROM far
"""

_NUMBER = "('0x' || substr(md5(domain), {at}, 4))::INT"
_AT = "(" + _NUMBER.format(at=5) + " + {shift}) % 366 * 86400 + 1704067200"

OP7 = f"""
WITH captures AS (SELECT page_id, url, page_id * 7919 % 366 * 86400 + page_id % 86400 + 1704067200 AS ts,
                         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
parents AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM hosts),
events AS (SELECT domain, CASE WHEN {_NUMBER.format(at=9)} % 2 = 0 THEN 'spam' ELSE 'malware' END AS list, k <> 1 AS adds,
                  {_AT.format(shift="97 * k")} AS ts FROM parents, range(3) s(k) WHERE {_NUMBER.format(at=1)} % 3 = 0
           UNION ALL SELECT host, 'phishing', true, {_AT.format(shift="0").replace("domain", "host")} FROM hosts
           WHERE {_NUMBER.format(at=1).replace("domain", "host")} % 5 = 0),
hits AS (SELECT page_id, domain, list, arg_max(adds, e.ts) AS active FROM captures c
         JOIN events e ON (c.host = e.domain OR ends_with(c.host, '.' || e.domain)) AND e.ts <= c.ts GROUP BY page_id, domain, list),
best AS (SELECT page_id, arg_max(domain, length(domain)) AS matched, count(DISTINCT list) AS n FROM hits WHERE active GROUP BY page_id)
SELECT page_id, url, ts AS fetched_s, matched IS NOT NULL AS blocked, matched, coalesce(n, 0) AS n_lists FROM captures LEFT JOIN best USING (page_id)
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
           FROM embeddings WHERE label IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, vec_id, score FROM scored WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10
"""

ORACLE = {"op13_hard_negatives": OP13, "op2_quality_rules": OP2, "op7_url_lists": OP7}
