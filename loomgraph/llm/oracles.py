"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host(url: str) -> str:
    return _LOWER.format(f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')")


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_path(url)} || coalesce(regexp_extract({url}, '(?s)^[^#]*?(\\?[^#]*)', 1), '') END"


_RULES = "(VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) AS r(kind, host, path, rule)"
_FIT = f"SELECT {{0}}, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.kind, length(r.rule)) AS kind FROM {{1}} u LEFT JOIN {_RULES} ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL"

#: Rules, then aliases by canonical links and meta refreshes: a node reaches a blocked one through links either way.
OP1 = f"""WITH RECURSIVE own AS (SELECT page_id, {_node("url")} AS node, {_host("url")} AS host, {_path("url")} AS path FROM pages),
  found AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?\\s*canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*([^"''>\\s]+)', 1)]) AS href FROM pages),
  target AS (SELECT url, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN 'http://' || {_host("url")} || href
    ELSE 'http://' || {_host("url")} || CASE WHEN regexp_extract({_path("url")}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_path("url")}, '(?s)^(.*/)', 1) END || href END AS dst
    FROM (SELECT url, trim(replace(href, '&amp;', '&')) AS href FROM found) WHERE href <> ''),
  one AS (SELECT DISTINCT {_node("url")} AS a, {_node("dst")} AS b FROM target), edges AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
  members AS (SELECT DISTINCT a AS node, {_host("('http://' || a)")} AS host, {_path("('http://' || a)")} AS path FROM edges),
  bad AS (SELECT node FROM ({_FIT.format("u.node", "members")}) WHERE kind = 'block'),
  reach AS (SELECT node FROM bad UNION SELECT b FROM reach JOIN edges ON a = reach.node),
  judged AS ({_FIT.format("u.page_id, u.node, u.host, u.path", "own")})
  SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""

_WORDS = f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

#: Windows of items and documents as word lists, joined by equality.
OP10 = f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), docs AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
  windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
  cut AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
  hits AS (SELECT k, i, n, item FROM cut JOIN windows USING (n, win)),
  places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY k),
  named AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN places USING (k) LEFT JOIN named USING (k)"""

_BLANKS = "[\\x20\\x09-\\x0D]+"
#: Sets of shingles; equal sets are one; pairs are counted over the shingles that more than one set has, from the
#: rarest fifth of each set on (linked sets share nine tenths, so they share one of these).
OP7 = f"""WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BLANKS}'), lambda w: w <> '') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM docs),
  classes AS (SELECT s, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
  each AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes), counts AS (SELECT x, count(*) AS f FROM each GROUP BY x HAVING count(*) > 1),
  ranked AS (SELECT each.c, n, each.x, row_number() OVER (PARTITION BY each.c ORDER BY coalesce(f, 1), each.x) AS r, f FROM each LEFT JOIN counts USING (x)),
  rare AS (SELECT c, n, x FROM ranked WHERE r <= n // 5 + 1 AND f IS NOT NULL),
  pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM rare a JOIN rare b ON a.x = b.x AND a.c < b.c AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
  links AS (SELECT a, b FROM pairs JOIN classes p ON p.c = a JOIN classes q ON q.c = b WHERE 100 * len(list_intersect(p.s, q.s)) >= 90 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
  ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b),
  least_ AS (SELECT a AS c, min(b) AS component FROM reach GROUP BY a)
  SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least_ USING (c)"""

#: Words by place within pieces; phrases are lists of words from each place on.
OP11 = f"""WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
  pieces AS (SELECT row_number() OVER () AS k, lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(p) AS p FROM docs)),
  total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY 1),
  places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
  f AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE i + d - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
  cand AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE d > 1),
  cuts AS (SELECT lang, d, phrase, a, w, unnest(generate_series(1, d - 1)) AS k FROM cand),
  scored AS (SELECT c.lang, c.phrase, c.a, k, p.f AS l, q.f AS r, n, (1000 * c.a * n) // (p.f * q.f) AS score FROM cuts c JOIN total USING (lang)
    JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:], ' ')),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inside AS (SELECT DISTINCT b.lang, b.phrase FROM cand b JOIN cand c ON c.lang = b.lang AND c.d > b.d AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best ANTI JOIN inside USING (lang, phrase))
  SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

ORACLES = {"op1_url_filters": OP1, "op7_jaccard_join": OP7, "op10_benchmark_decontamination": OP10, "op11_collocations": OP11}
