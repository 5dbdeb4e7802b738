"""DuckDB references of the corpus queries, over the tables as views."""

WORD = "[^\\x20\\x09-\\x0D]+"

MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(z) OVER ()::BIGINT AS t, 3 * z AS most,
        coalesce(sum(3 * z) OVER b, 0)::BIGINT AS fixed, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS open
      FROM s WINDOW b AS (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(first((t - fixed) / open ORDER BY z / w, source NULLS LAST) FILTER (WHERE w * ((t - fixed) / open) <= most), 0) AS level FROM o),
r AS (SELECT source, z AS source_size, least(w * level, most::DOUBLE) AS target FROM o, l),
c AS (SELECT d.doc_id, d.size, d.source, r.source_size, r.target,
        CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        md5('mix-2|' || coalesce(d.doc_id::VARCHAR, '')) AS h
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, (('0x' || substr(h, 1, 10))::BIGINT + k * ('0x' || substr(h, 11, 10))::BIGINT) % 1099511627776 / 1099511627776.0::DOUBLE < rate - floor(rate) AS more
      FROM c, range(32) AS draws(k)),
b AS (SELECT source, arg_min(k, (off, k)) AS k FROM
      (SELECT source, k, abs((sum(size * floor(rate)::BIGINT) + coalesce(sum(size) FILTER (WHERE more), 0))::DOUBLE - any_value(target)) AS off FROM k GROUP BY source, k) GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + more::BIGINT))::BIGINT AS taken
FROM k JOIN b ON k.k = b.k AND k.source IS NOT DISTINCT FROM b.source
"""

URLS = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM u),
rules(action, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, host, path, first(h || q ORDER BY length(h || q) DESC) FILTER (WHERE h IS NOT NULL) AS rule, first(action ORDER BY length(h || q) DESC) FILTER (WHERE h IS NOT NULL) AS action
      FROM (SELECT row_number() OVER () AS n, * FROM p) x LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY n, page_id, host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.x, reach.r FROM reach JOIN links ON links.y = reach.doc_id)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = reach.doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM v GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS place FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM v JOIN f USING (k) WHERE m < doc_id)),
g AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
t AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM g))),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN c ON c.doc_id = t.doc_id AND c.place = t.i GROUP BY t.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

RANKED = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN d ON d.doc_id = f.doc_id, c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {"op11_ranked_search": RANKED, "op2_near_dedup": NEAR, "op6_substring_dedup": REPEATS, "op3_mix_sources": MIX, "op9_url_filter": URLS}
