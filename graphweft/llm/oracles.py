"""SQL for DuckDB that gives the rows of those queries that SQL can express, written without their operators."""

from __future__ import annotations

from graphweft.llm import audit, licenses, mixing, phrases, substrings, urls

_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
     win AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {substrings.WINDOW}], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {substrings.WINDOW - 1})) AS i FROM w)),
     rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
     cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS p FROM rep),
     kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n
              FROM (SELECT doc_id, unnest(ws) AS t, unnest(range(0, len(ws))) AS p FROM w) x ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _stands(i: str, phrase: str) -> str:
    return "(" + " AND ".join(f"ws[{i} + {j}] = '{word}'" for j, word in enumerate(phrase.split())) + ")"


_PLACES = {phrase: f"list_filter(range(1, len(ws) + 1), lambda i: {_stands('i', phrase)})" for phrase in licenses.PHRASES}
LICENSES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
     p AS (SELECT doc_id, len(ws) AS n_words, {", ".join(f"{places} AS {licenses.PHRASES[phrase]}" for phrase, places in _PLACES.items())} FROM w),
     q AS (SELECT *, list_sort({" || ".join(licenses.PHRASES.values())}) AS places FROM p)
SELECT doc_id, n_words, len(places) AS n_base, places[1] - 1 AS first_word, places[-1] - 1 AS last_word,
       concat_ws(',', {", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in sorted(licenses.PHRASES.values()))}) AS base_labels FROM q
"""


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', {', '.join(parts)})), 1, 8) AS BIGINT)"


_B = mixing.BLOCK_WORDS
MIXING = f"""
WITH named AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
     sized AS (SELECT doc_id, source, size, name || CASE WHEN number > 1 THEN '#' || number ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, name) AS number FROM named)),
     per0 AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
     per1 AS (SELECT *, CAST({list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST(source_size * {mixing.MOST_REPEATS} AS DOUBLE) AS most FROM per0),
     per2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate FROM per1
              WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     per AS (SELECT source, docs, source_size, least(most, coalesce(max(rate) FILTER (WHERE rate * weight <= most) OVER () * weight, most)) AS target FROM per2),
     rows AS (SELECT s.doc_id, s.name, s.source, s.size, source_size, target, CAST({_draw("'shard'", "s.name")} % CAST(ceil(docs / {mixing.SHARD_DOCS}) AS BIGINT) AS INT) AS shard FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source),
     cells AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell_size, any_value(CASE WHEN source_size > 0 THEN target ELSE 0 END) AS t, any_value(source_size) AS z FROM rows GROUP BY 1, 2),
     shares AS (SELECT source, shard, cell_size, CASE WHEN z > 0 THEN t * cell_size / z ELSE 0.0 END AS share FROM cells),
     seats AS (SELECT *, CAST(floor(sum(share) OVER (PARTITION BY shard) / {_B} + 0.5) AS BIGINT) AS n, sum(share) OVER (PARTITION BY shard) AS whole, count(*) OVER (PARTITION BY shard) AS parties FROM shares),
     quotients AS (SELECT source, shard, n, share / (2 * k + 1) AS q, k FROM (SELECT *, unnest(range(0, CAST(floor(share * n / whole) AS BIGINT) + parties + 2)) AS k FROM seats WHERE share > 0)),
     won AS (SELECT source, shard, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY q DESC, source NULLS LAST, k) AS r FROM quotients) WHERE r <= n GROUP BY 1, 2),
     due AS (SELECT s.source, s.shard, s.cell_size, CAST(ceil(s.cell_size / {_B}) AS BIGINT) AS blocks, coalesce(w.seats, 0) AS seats FROM seats s LEFT JOIN won w ON w.shard = s.shard AND w.source IS NOT DISTINCT FROM s.source),
     cell AS (SELECT *, least(seats, blocks * {mixing.MOST_REPEATS}) // greatest(blocks, 1) AS rounds, least(seats, blocks * {mixing.MOST_REPEATS}) % greatest(blocks, 1) AS extra,
                     {_draw("'start'", "coalesce(source, '')", "CAST(shard AS VARCHAR)")} % greatest(blocks, 1) * {_B} AS first FROM due),
     placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY {_draw("'order'", "name")}, name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM rows),
     both_ AS (SELECT p.*, c.rounds, c.first, c.cell_size, c.first + least(c.extra * {_B}, c.cell_size) AS stop FROM placed p JOIN cell c ON c.shard = p.shard AND c.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(least(lo + size, least(stop, cell_size)) - greatest(lo, first), 0) + greatest(least(lo + size, greatest(stop - cell_size, 0)) - greatest(lo, 0), 0) AS BIGINT) AS taken FROM both_
"""

_RULES = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _RULES]
_GENERATED = "(regexp_matches(s, '^([0-9]+([.][a-z]+)?|[0-9a-fA-F-]{16,})$') OR (length(s) >= 20 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')))"


_M = urls.SMOOTHING

URLS = f"""
WITH RECURSIVE parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     ruled AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _FITS)} END AS given,
                      list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN {_GENERATED} THEN '*' ELSE s END) AS marked FROM parsed),
     shaped AS (SELECT *, list_filter(marked, lambda s, i: i = 1 OR s <> marked[i - 1]) AS shape FROM ruled),
     nodes AS (SELECT host, shape, count(*) AS pages, count(given) AS labelled, count(*) FILTER (WHERE given = 'block') AS blocked FROM shaped GROUP BY 1, 2),
     names AS (SELECT host, n, k, unnest(range(1, len(parts) + 1)) AS level, array_to_string(parts[len(parts) - level + 1 :], '.') AS domain
               FROM (SELECT host, string_split(host, '.') AS parts, sum(labelled) AS n, sum(blocked) AS k FROM nodes GROUP BY 1, 2)),
     domains AS (SELECT domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM names GROUP BY 1),
     chains AS (SELECT host, list({{'p': 0.0::DOUBLE, 'n': d.n, 'k': d.k}} ORDER BY level) AS c FROM names JOIN domains d USING (domain) GROUP BY 1),
     hosts AS (SELECT host, list_reduce(list_prepend({{'p': 0.0::DOUBLE, 'n': -1::BIGINT, 'k': 0::BIGINT}}, c), lambda a, x: CASE WHEN x.n = a.n THEN a ELSE {{'p': (x.k + {_M} * a.p) / (x.n + {_M}), 'n': x.n, 'k': x.k}} END).p AS p FROM chains),
     walk AS (SELECT host, shape, pages, labelled, blocked, '' AS template, shape AS rest, CAST(p AS DOUBLE) AS purity, false AS ended FROM nodes JOIN hosts USING (host)
              UNION ALL
              SELECT host, shape, pages, labelled, blocked, template || CASE WHEN shapes > 1 THEN step ELSE coalesce('/' || nullif(array_to_string(rest, '/'), ''), '') END, rest[2:],
                     CAST(CASE WHEN shapes = 1 OR branches = 1 THEN purity
                               WHEN n = 0 AND known > 0 AND NOT (abs(own_pages - known_pages / known) <= {urls.DEVIATIONS} * sqrt(own_pages + known_pages / known)
                                    AND abs(own_starred / own_pages - known_starred / known_pages) <= {urls.DEVIATIONS} * sqrt((own_starred + known_starred) / (own_pages + known_pages) * (1 - (own_starred + known_starred) / (own_pages + known_pages)) * (1 / own_pages + 1 / known_pages)))
                                    THEN purity * (2 * least(own_pages, known_pages / known) / (own_pages + known_pages / known) * (1 - abs(own_starred / own_pages - known_starred / known_pages)))
                               WHEN apart THEN (k + {_M} * purity) / (n + {_M})
                               ELSE (sum(blocked) FILTER (WHERE NOT apart) OVER node + {_M} * purity) / (sum(labelled) FILTER (WHERE NOT apart) OVER node + {_M}) END AS DOUBLE), shapes = 1 OR segment = ''
              FROM (SELECT *, coalesce(abs(k - n * whole_k / nullif(whole_n, 0)) > {urls.DEVIATIONS} * sqrt(n * (whole_k / nullif(whole_n, 0)) * (1 - whole_k / nullif(whole_n, 0))), false) AS apart
                    FROM (SELECT *, count(DISTINCT CASE WHEN n > 0 THEN step END) OVER node AS known, sum(CASE WHEN n > 0 THEN pages END) OVER node AS known_pages, sum(CASE WHEN n > 0 THEN starred END) OVER node AS known_starred FROM (
                          SELECT *, sum(pages) OVER branch AS own_pages, sum(starred) OVER branch AS own_starred, sum(labelled) OVER branch AS n, sum(blocked) OVER branch AS k, sum(labelled) OVER node AS whole_n, sum(blocked) OVER node AS whole_k, count(DISTINCT step) OVER node AS branches
                          FROM (SELECT *, CASE WHEN segment = '' THEN '' WHEN children > {urls.CHILDREN} AND support < {urls.RARE} THEN '/*' ELSE '/' || segment END AS step
                                FROM (SELECT *, sum(pages) OVER (PARTITION BY host, template, segment) AS support, count(DISTINCT segment) OVER node AS children, count(*) OVER node AS shapes
                                      FROM (SELECT *, coalesce(rest[1], '') AS segment, CASE WHEN rest[2] = '*' THEN pages ELSE 0 END AS starred FROM walk WHERE NOT ended) WINDOW node AS (PARTITION BY host, template)))
                          WINDOW node AS (PARTITION BY host, template), branch AS (PARTITION BY host, template, step)) WINDOW node AS (PARTITION BY host, template)))
              WINDOW node AS (PARTITION BY host, template))
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.given, CASE WHEN purity > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped s LEFT JOIN walk t ON t.ended AND t.host = s.host AND t.shape = s.shape
"""

_ONE_OF_EACH = " AND ".join(f"{a}.f <> {b}.f" for i, a in enumerate("vwxyz") for b in "vwxyz"[:i])
#: Counts by the filters that a document fails, and for each order the first of these in it.
AUDIT = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy FROM documents),
     words AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM texts),
     failing AS (SELECT doc_id, part, concat(CASE WHEN len(ws) < {audit.LEAST_WORDS} THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < {audit.LEAST_DISTINCT} * len(ws) THEN 'B' END,
                        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.MOST_CAPITALS} * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN copy THEN 'E' END) AS fails FROM words),
     marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
     groups AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM failing LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
     letters AS (SELECT unnest(string_split('A B C D E', ' ')) AS f),
     orders AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z WHERE {_ONE_OF_EACH}),
     met AS (SELECT *, list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))) AS first FROM orders, groups),
     steps AS (SELECT part, filter_order, step, filter_order[step] AS f, coalesce(sum(n) FILTER (WHERE first IS NULL OR first > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE first = step), 0) AS removed,
                      coalesce(sum(n) FILTER (WHERE contains(fails, filter_order[step]) AND first < step), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = filter_order[step]), 0) AS unique_fails,
                      coalesce(sum(g) FILTER (WHERE first = step), 0) AS good_lost, coalesce(sum(t) FILTER (WHERE first = step), 0) AS toxic_lost FROM met, range(1, 6) s(step) GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM steps
"""

PHRASES = f"""
WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM (SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
     sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY 1),
     places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
     f AS (SELECT lang, d, g, count(*) AS f FROM (SELECT lang, d, ws[i : i + d - 1] AS g FROM places, range(1, {phrases.LONGEST + 1}) r(d) WHERE i + d - 1 <= len(ws)) GROUP BY 1, 2, 3 HAVING count(*) >= {phrases.LEAST}),
     c AS (SELECT lang, d, g, f AS a FROM f WHERE d > 1),
     cuts AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (CAST({phrases.SCALE} AS HUGEINT) * c.a) // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, d)) AS k FROM c) c
              JOIN f x ON x.lang = c.lang AND x.g = c.g[:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
     scored AS (SELECT lang, g, a, min((score, k, l, r)) AS cut FROM (SELECT lang, g, a, {{'score': score, 'k': k, 'l': l, 'r': r}} AS s, score, k, l, r FROM cuts) GROUP BY 1, 2, 3),
     inner_ AS (SELECT lang, g[s : s + n - 1] AS g, max(a) AS longer FROM c, range(2, {phrases.LONGEST}) t(n), range(1, {phrases.LONGEST}) u(s) WHERE n < d AND s + n - 1 <= d GROUP BY 1, 2),
     kept AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.cut[3] AS l, s.cut[4] AS r, CAST(s.cut[1] AS BIGINT) AS score FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100 * longer < {phrases.DROP_SHARE} * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang) WHERE rank <= {phrases.TOP}
"""
