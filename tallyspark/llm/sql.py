"""DuckDB twins of the queries that SQL can express.

Op 1, 7, 8, 11, 12 and 13 are exact in SQL. The others have none: 2, 3, 6, 9 and 10 hash or decode whole texts by methods without an
SQL form or are too slow there, 4 needs positions of matches and sliding windows, 5 edits a map in a loop; tests hold
them against brute force, exact round trips or held-out accuracy.
"""

import zlib

from tallyspark.llm import license_scan

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1)"
_KEPT = rf"list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')))"

_OP1 = rf"""WITH p AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path, array_to_string({_KEPT}, '&') AS q FROM pages),
c AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN coalesce(q, '') = '' THEN '' ELSE '?' || q END END AS url_key FROM p),
listed AS (SELECT DISTINCT url_key FROM c WHERE url_key IS NOT NULL AND regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM (SELECT r.*, coalesce(r.url_key IN (SELECT url_key FROM listed), false) AS listed FROM r)"""

_KEY = "CAST('0x' || substr(md5('mix-1:' || whole_epochs || ':' || doc_id), 1, 15) AS BIGINT)"
_DOMAIN = "list_extract(['web', 'reference', 'forum', 'code'], CAST(crc % 4 + 1 AS INTEGER))"


def _share(name: str, nodes: str, parent: str, budget: str, keys: str) -> str:
    """CTEs that give the nodes of each parent their part of its budget, as the operator does."""
    return f"""{name}_o AS (SELECT *, CAST(capacity AS DOUBLE) / weight AS ratio FROM {nodes}),
{name}_s AS (SELECT *, greatest(CAST({budget} AS HUGEINT) - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY ratio, node_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, node_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {name}_o),
{name}_f AS (SELECT *, CAST(capacity AS HUGEINT) * w <= rest * weight AS fits FROM {name}_s),
{name}_l AS (SELECT {parent}, min({{'a': ratio, 'b': node_key, 'rest': rest, 'w': w}}) FILTER (WHERE NOT fits) AS level FROM {name}_f GROUP BY {parent}),
{name} AS (SELECT f.*, CASE WHEN fits THEN capacity ELSE least(capacity, CAST(level.rest * weight // level.w AS BIGINT)) END AS part FROM {name}_f f JOIN {name}_l l USING ({parent}))"""


#: DuckDB has no crc32, so the checksums of the tables' source names are spelled out
_SOURCES = " ".join(f"WHEN 'src{i}' THEN {zlib.crc32(f'src{i}'.encode())}" for i in range(64))
_OP7 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CASE source {_SOURCES} END AS crc, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
e AS (SELECT *, {_DOMAIN} AS domain FROM d),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS leaf_tokens FROM e GROUP BY 1, 2, 3),
langs AS (SELECT domain, lang, CAST(sum(leaf_tokens) * 2 AS BIGINT) AS capacity FROM leaf GROUP BY 1, 2),
total AS (SELECT CAST(sum(leaf_tokens) * 9 // 10 AS BIGINT) AS root FROM leaf),
n1 AS (SELECT domain, domain AS node_key, CAST(sum(capacity) AS BIGINT) AS capacity, CASE domain WHEN 'web' THEN 4 WHEN 'reference' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END AS weight, (SELECT root FROM total) AS root FROM langs GROUP BY domain),
{_share("s1", "n1", "root", "root", "domain")},
n2 AS (SELECT g.domain, lang, lang AS node_key, g.capacity, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight, s1.part AS budget FROM langs g JOIN s1 ON g.domain = s1.domain),
{_share("s2", "n2", "domain", "budget", "lang")},
n3 AS (SELECT leaf.domain || '|' || leaf.lang AS parent, leaf.domain, leaf.lang, leaf.source, leaf.source AS node_key, leaf.leaf_tokens * 2 AS capacity, 1 AS weight, s2.part AS budget, leaf_tokens FROM leaf JOIN s2 ON leaf.domain = s2.domain AND leaf.lang = s2.lang),
{_share("s3", "n3", "parent", "budget", "source")},
p AS (SELECT domain, lang, source, part AS leaf_budget, CASE WHEN leaf_tokens > 0 THEN part // leaf_tokens ELSE 2 END AS whole_epochs, leaf_tokens FROM s3),
k AS (SELECT e.doc_id, e.domain, e.lang, e.source, e.tokens, leaf_budget, whole_epochs, leaf_budget - whole_epochs * leaf_tokens AS left_tokens, {_KEY} AS order_key FROM e JOIN p USING (domain, lang, source)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_key) AS upto FROM k)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget, CAST(whole_epochs + CASE WHEN left_tokens > 0 AND upto <= left_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM u"""

_PART = "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1), '' ORDER BY i) FROM range(32) t(i))"
_OP8 = f"""WITH s AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS kept FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_PART} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM b"""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
_CHAIN = ", ".join(f"{_LETTERS} p{i}(l, b)" for i in range(1, 6))
_DIFFER = " AND ".join(f"p{i}.l <> p{j}.l" for i in range(1, 6) for j in range(i + 1, 6))
_OP11 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY 1, 2),
o AS (SELECT p1.l || p2.l || p3.l || p4.l || p5.l AS filter_order, [p1.b, p2.b, p3.b, p4.b, p5.b] AS bits FROM {_CHAIN} WHERE {_DIFFER}),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (own | before) = 0) AS kept, sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS removed, sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0) AS redundant,
  sum(n) FILTER (WHERE mask = own) AS unique_fails, sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS toxic_lost
  FROM h, (SELECT filter_order, step, own, CAST(before AS INTEGER) AS before FROM s) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP12 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark)),
c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, 10 + (90 * n * (SELECT docs FROM c)) // (SELECT words FROM c) AS m FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term, n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def _templates() -> str:
    """The templates as rows: number, label, width, how many words a block must hold, a word."""
    known = license_scan.TEMPLATES
    rows = []
    for i, (label, text) in enumerate(known):
        own = license_scan.plain_terms(text)
        need = license_scan.needed(len(set(own)), license_scan.LEAST)
        rows += [f"({i}, '{label}', {license_scan.width_of(len(own))}, {need}, {len(set(own))}, '{w}')" for w in sorted(set(own))]
    return f"(VALUES {', '.join(rows)}) k(template, label, width, need, t, word)"


_PAIR = {label: phrase.split() for phrase, label in license_scan.PHRASES}
_BASE = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase)) for label, phrase in _PAIR.items()
)
_OP13 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
k AS (SELECT * FROM {_templates()}),
b AS ({_BASE}),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY 1),
h AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d) WHERE word IN (SELECT word FROM k)),
x AS (SELECT DISTINCT doc_id, template, label, need, t, h.word, pos // (width // 2) - back AS block FROM h JOIN k ON h.word = k.word, range(2) r(back)),
m AS (SELECT doc_id, template, label, block, count(*) / max(t) AS containment FROM x WHERE block >= 0 GROUP BY ALL HAVING count(*) >= max(need)),
mm AS (SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS score FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": _OP1, "op7_mix_budgets": _OP7, "op8_warc_revisits": _OP8, "op11_filter_audit": _OP11, "op12_tiered_search": _OP12, "op13_license_scan": _OP13}
