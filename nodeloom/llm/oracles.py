"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM per_source),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(most, coalesce(weight * (SELECT max(level) FROM leveled WHERE most / weight >= level), most)) AS target FROM leveled),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS turns FROM goals),
placed AS (
  SELECT z.*, g.source_size, g.target, g.turns, CAST(round(g.target - g.turns * g.source_size) AS BIGINT) AS rest,
         sum(size) OVER (PARTITION BY z.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY z.source, place) AS here
  FROM sized z JOIN split g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(turns * size + CASE WHEN upto <= rest THEN size WHEN upto - here < rest THEN floor((rest - (upto - here)) * size / here) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_rlz_substrings"] = rf"""
WITH w AS (
  SELECT doc_id, {WORDS_SQL} AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w),
phrases AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM starts),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY phrase) AS first FROM phrases) WHERE first < doc_id),
gone AS (
  SELECT DISTINCT doc_id, i + j AS place FROM repeated, range(13) t(j)),
lost AS (
  SELECT doc_id, list(place) AS places, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < place - 1) AS spans
  FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY doc_id),
each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM each_word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(lost.spans, 0) AS n_spans
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op5_minmax_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 1 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
classes AS (
  SELECT min(doc_id) AS node, shingles, len(shingles) AS n FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM sets) WHERE len(shingles) > 0 GROUP BY shingles),
each_shingle AS (
  SELECT node, n, unnest(shingles) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.node AS u, b.node AS v FROM each_shingle a JOIN each_shingle b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (
  SELECT node, node FROM classes UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u),
components AS (
  SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
known AS (
  SELECT s.doc_id, len(s.shingles) AS n, c.component FROM sets s LEFT JOIN classes k ON list_sort(s.shingles) = k.shingles LEFT JOIN components c USING (node))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM known
"""

ORACLES["op7_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (
  SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(digest, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES["op11_filter_interactions"] = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
orders AS (
  SELECT [a, b, c, d, e] AS p FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
gone AS (
  SELECT part, p, coalesce(list_position(list_transform(p, lambda f: fails[f]), true), 6) AS goes, fails, n, good, toxic FROM sets, orders),
steps AS (
  SELECT part, p, CAST(step AS INTEGER) AS step, p[step] AS f, sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN goes < step AND fails[p[step]] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[p[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN goes = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, range(1, 6) s(step) GROUP BY part, p, step)
SELECT part, array_to_string(list_transform(p, lambda f: 'ABCDE'[f]), '') AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""

ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, 5) t(k)),
f AS MATERIALIZED (
  SELECT lang, k, p, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 30),
n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, k, p, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scores AS (
  SELECT c.*, l.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.p = c.p[:c.cut] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.cut + 1:]),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, a, k, p, unnest(range(2, k)) AS length FROM f WHERE k > 2),
inner_ AS (
  SELECT lang, a, unnest(list_transform(range(1, k - length + 2), lambda i: p[i:i + length - 1])) AS p FROM longer),
covered AS (
  SELECT lang, p, max(a) AS most FROM inner_ GROUP BY ALL),
left_ AS (
  SELECT b.* FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.p = b.p WHERE c.most IS NULL OR 100 * c.most < 80 * b.a),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ') COLLATE "binary") AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
