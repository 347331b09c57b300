"""SQL for the training-data queries that it can express."""

from __future__ import annotations

from . import quality_rules, url_filter

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7 = rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
at_ AS (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35),
wins AS (SELECT rid, p, array_to_string(ws[p:p + 34], ' ') AS g FROM at_),
rep AS (SELECT g FROM wins GROUP BY g HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT k) AS ks FROM (SELECT rid, unnest(range(p, p + 35)) AS k FROM wins JOIN rep USING (g)) GROUP BY rid),
kept AS (SELECT w.rid, array_to_string(list(word ORDER BY k), ' ') AS body FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w) w LEFT JOIN gone USING (rid) WHERE ks IS NULL OR NOT list_contains(ks, k) GROUP BY w.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS ts FROM benchmark),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS (SELECT iid, item_id, term, count(*)::BIGINT AS k FROM (SELECT iid, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT iid, item_id, rid, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

_FIRST = "CASE " + " ".join(f"WHEN {scale} * {what} > {c} * n_words THEN {i}" for i, (what, scale, c) in enumerate(quality_rules.STEPS)) + f" ELSE {len(quality_rules.STEPS)} END"
OP4 = rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
grams AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS k FROM grams JOIN twice USING (rid, g)) GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {_FIRST} AS first FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stratum, first FROM b JOIN good USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (first <= step) AS k FROM held, range({len(quality_rules.STEPS)}) r(step) GROUP BY ALL),
tail AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK})))) AS p FROM counts),
taken AS (SELECT stratum, count(*) FILTER (k < n * {quality_rules.RISK} AND p <= {quality_rules.DOUBT} / (SELECT count(DISTINCT stratum) FROM held)) AS steps FROM tail GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first >= coalesce(steps, 0) AS kept FROM b LEFT JOIN taken USING (stratum)"""


def op8(rules: list[tuple[str, str, str]], thin: int) -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (h, p, _) in enumerate(sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))))
    ordered = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))
    rule, verdict = fits.format(*[f"'{h}{p}'" for h, p, _ in ordered]), fits.format(*[f"'{v}'" for *_, v in ordered])
    parts = url_filter.PARTS
    tracking = r"([?&])(utm_[a-z]+|ref)=[^&]*(&|$)"
    return rf"""WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path, coalesce(regexp_extract(url, '{parts}', 3), '') AS q FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') || regexp_replace(regexp_replace(regexp_replace(q, '{tracking}', '\1', 'g'), '{tracking}', '\1', 'g'), '[?&]$', '') END AS canon FROM u),
listed AS (SELECT DISTINCT canon FROM c WHERE length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) < {thin} AND canon IS NOT NULL)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(canon IN (SELECT canon FROM listed), false) AS listed FROM c"""


def op1() -> str:
    from . import secret_scan as s

    text = lambda p: p.replace("'", "''")
    bare = "[A-Za-z0-9_-]{20,}"  # leftmost and greedy: the look-behind changes nothing
    kinds = ", ".join(f"({k}, '{s.KINDS[k]}', '{text(p)}')" for k, p in enumerate((s.ASSIGN, s.ACCESS, s.HEX, bare)))
    lens = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
k(rank, kind, pat) AS (VALUES {kinds}),
f AS (SELECT rid, rank, kind, string_split_regex(t, pat) AS g, regexp_extract_all(t, pat, 0) AS h FROM t, k WHERE regexp_matches(t, pat)),
p AS (SELECT rid, rank, kind, h[i] AS v, ({lens('g[1:i]')} + {lens('h[1:i - 1]')})::BIGINT AS a FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM f)),
v AS (SELECT rid, rank, kind, a, a + length(v) AS b, CASE WHEN rank = 0 THEN regexp_extract(v, '{text(s.ASSIGN)}', 2) ELSE v END AS val FROM p),
w AS (SELECT * FROM v WHERE CASE rank WHEN 0 THEN length(val) >= 6 WHEN 3 THEN regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 10 ELSE true END),
x AS (SELECT * FROM w WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM w o WHERE o.rid = w.rid AND o.rank < 3 AND o.a < w.b AND w.a < o.b)),
own AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT owner) >= {s.COPIED_OWNERS} OR count(DISTINCT repo) >= {s.COPIED_REPOS} AS copied FROM x JOIN t USING (rid) GROUP BY val),
y AS (SELECT * FROM x JOIN own USING (val)),
z AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3 OR owners = 1 AND NOT copied) AS spans,
  count(*) FILTER (owners = 1 AND NOT copied AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 10) AS n_live, count(*) FILTER (copied AND rank < 3) AS n_copied FROM y GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN z USING (rid)"""
