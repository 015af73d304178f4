"""The same rows as the numbered queries in SQL, where SQL can express the operator."""

OP4 = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
per AS MATERIALIZED (
  SELECT src, no_src, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1 AS w
  FROM sized GROUP BY src, no_src),
shared AS (  -- what is above three times a source's size is shared again by weight, until nothing is above
  SELECT 0 AS step, src, no_src, source_size, cap, w, sum(source_size) OVER ()::DOUBLE / sum(w) OVER ()::DOUBLE * w AS target, false AS closed FROM per
  UNION ALL
  SELECT step + 1, src, no_src, source_size, cap, w,
         CASE WHEN full_ THEN cap::DOUBLE ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (full_) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT full_) OVER ())::DOUBLE * w END, full_
  FROM (SELECT *, closed OR target > cap AS full_ FROM shared) WHERE step < (SELECT count(*) FROM per)),
goal AS MATERIALIZED (
  SELECT *, greatest(target - sure * source_size, 0.0) AS rest FROM (
    SELECT src, no_src, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS sure
    FROM shared WHERE step = (SELECT max(step) FROM shared))),
drawn AS (  -- probabilities by size; those that would pass 1 are certain, and the others share the rest again
  SELECT 0 AS step, doc_id, src, no_src, size, u, source_size, target, sure, rest, rest AS wanted,
         size * (rest / sum(size::HUGEINT * size) OVER (PARTITION BY src, no_src)::DOUBLE) AS p, false AS closed
  FROM sized JOIN goal USING (src, no_src)
  UNION ALL
  SELECT step + 1, doc_id, src, no_src, size, u, source_size, target, sure, rest,
         rest - coalesce(sum(size) FILTER (full_) OVER s, 0)::DOUBLE,
         CASE WHEN full_ THEN 1 ELSE size * ((rest - coalesce(sum(size) FILTER (full_) OVER s, 0)::DOUBLE) / (sum(size::HUGEINT * size) FILTER (NOT full_) OVER s)::DOUBLE) END, full_
  FROM (SELECT *, closed OR coalesce(p > 1, false) AS full_, max((NOT closed AND coalesce(p > 1, false))::INT) OVER () AS any_ FROM drawn)
  WHERE any_ = 1 WINDOW s AS (PARTITION BY src, no_src)),
odds AS (
  SELECT *, CASE WHEN size > 0 AND p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn WHERE step = (SELECT max(step) FROM drawn)),
running AS (  -- rows alike in rank are taken together
  SELECT *, sum(size) OVER (PARTITION BY src, no_src, q, doc_id, size) AS alike,
         sum(size) OVER (PARTITION BY src, no_src, q IS NULL ORDER BY q, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM odds)
SELECT doc_id, size, source_size, target,
       (size * (sure + CASE WHEN size > 0 AND p >= 1 THEN 1 ELSE 0 END + CASE WHEN q IS NOT NULL AND upto - alike / 2 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP6 = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM split),
hp AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM parts),
outcome AS (
  SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INTEGER) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-(1 + depth):], '.') AS domain, array_to_string(string_split(host, '.')[-depth:], '.') AS suffix, n, bad
  FROM (SELECT host, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (
      'ac.jp', 'ac.uk', 'co.id', 'co.il', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.co', 'com.hk',
      'com.mx', 'com.my', 'com.sg', 'com.tr', 'com.tw', 'com.ua', 'gov.au', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk') THEN 2 ELSE 1 END AS depth,
      count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM hp LEFT JOIN outcome USING (page_id) GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY suffix),
levels AS (
  SELECT 'host' AS level, n, bad FROM hosts UNION ALL SELECT 'domain', n, bad FROM domains UNION ALL SELECT 'suffix', n, bad FROM suffixes),
sums AS (
  SELECT level, count(*) AS g, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n) AS bbn
  FROM levels WHERE n > 0 GROUP BY level),
moments AS (
  SELECT *, bad / n AS mean, bad / n * (1 - bad / n) AS chance, (bbn - bad / n * (bad / n) * n) / (g - 1) AS spread,
         (n - nn / n) / (g - 1) AS each FROM sums WHERE g >= 2),
strengths AS (
  SELECT level, CASE WHEN NOT (bad > 0 AND bad < n) OR each <= 1 OR spread <= chance THEN 1000.0
    ELSE round(least(1000.0, greatest(1.0, 1 / least(1.0, (spread - chance) / (chance * (each - 1))) - 1)), 6) END AS k FROM moments),
k AS (
  SELECT coalesce(max(k) FILTER (level = 'host'), 1000.0)::DOUBLE AS kh, coalesce(max(k) FILTER (level = 'domain'), 1000.0)::DOUBLE AS kd,
         coalesce(max(k) FILTER (level = 'suffix'), 1000.0)::DOUBLE AS ks FROM strengths),
overall AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
s AS (SELECT suffix, (bad + ks * m) / (n + ks) AS of_suffix FROM suffixes, k, overall),
d AS (SELECT domain, (bad + kd * of_suffix) / (n + kd) AS of_domain FROM domains JOIN s USING (suffix), k),
p AS (SELECT host, (bad + kh * of_domain) / (n + kh) AS mean, n + kh AS n FROM hosts JOIN d USING (domain), k),
bounds AS (SELECT host, mean - 1.0 * sqrt(mean * (1 - mean) / (n + 1)) AS bound, m AS overall FROM p, overall),
ruled AS (
  SELECT hp.*, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM hp)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > overall THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN bounds USING (host)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS j FROM d),
inked AS (SELECT doc_id, ls, j, ls[j] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS q, ('0x' || substr(md5(ls[j]), 1, 8))::BIGINT AS hash FROM l WHERE regexp_matches(ls[j], '[^\x20\x09-\x0D]')),
win AS (SELECT a.doc_id, a.ls, a.q, a.j, b.j AS last, a.line AS one, b.line AS two, (a.hash * 31 + b.hash) % 4294967291 AS v FROM inked a JOIN inked b ON b.doc_id = a.doc_id AND b.q = a.q + 1),
often AS (SELECT one, two FROM win GROUP BY one, two HAVING count(*) > 1),
rep AS (SELECT win.* FROM win JOIN often ON win.one = often.one AND win.two = often.two),
cuts AS (
  SELECT m.doc_id, m.q FROM rep m JOIN rep b ON b.doc_id = m.doc_id AND b.q = m.q - 1 AND m.v < b.v JOIN rep a ON a.doc_id = m.doc_id AND a.q = m.q + 1 AND m.v < a.v
  WHERE NOT EXISTS (SELECT 1 FROM rep f WHERE f.doc_id = m.doc_id AND abs(f.q - m.q) = 2 AND f.v <= m.v)),
island AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS g FROM rep WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.doc_id = rep.doc_id AND cuts.q = rep.q)),
spans AS (SELECT doc_id, any_value(ls) AS ls, min(j) AS a, max(last) AS b, max(q) AS q FROM island GROUP BY doc_id, g),
ended AS (SELECT s.doc_id, s.ls, s.a, coalesce(c.last - 1, s.b) AS b FROM spans s LEFT JOIN (SELECT rep.* FROM rep JOIN cuts ON cuts.doc_id = rep.doc_id AND cuts.q = rep.q) c ON c.doc_id = s.doc_id AND c.q = s.q + 1),
pieces AS (
  SELECT doc_id, a, b, array_to_string(ls[a:b], chr(10)) AS chunk FROM ended
  UNION ALL
  SELECT doc_id, j, j, line FROM inked WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
seen AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS nth FROM pieces),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS j FROM seen WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.j)::BIGINT AS n_removed,
         coalesce(string_agg(l.ls[l.j], chr(10) ORDER BY l.j) FILTER (gone.j IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.j = l.j GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN kept.text END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

_SHINGLES = r"""
  SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END) AS s
  FROM (SELECT id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {t})"""

OP8 = f"""
WITH d AS ({_SHINGLES.format(t="(SELECT doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL)")}),
b AS ({_SHINGLES.format(t="(SELECT item_id AS id, text FROM benchmark WHERE item_id IS NOT NULL)")}),
m AS (SELECT id, count(*)::BIGINT AS n_item FROM b GROUP BY id),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared FROM d JOIN b USING (s) GROUP BY d.id, b.id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN m ON m.id = item_id WHERE n_shared * 100 >= n_item * 80
"""

OP3 = f"""
WITH RECURSIVE g AS MATERIALIZED ({_SHINGLES.format(t="(SELECT doc_id AS id, text FROM documents)")}),
n AS MATERIALIZED (SELECT id, count(*)::BIGINT AS n FROM g GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id),
linked AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE common * 100 >= (na.n + nb.n - common) * 80),
e AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.id = a GROUP BY a
"""

ORACLE_SQL = {
    "op2_topk": OP2, "op3_ngram_join": OP3, "op4_mixing": OP4, "op6_urls": OP6, "op7_lines": OP7, "op8_decontamination": OP8,
}
