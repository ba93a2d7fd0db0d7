"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from parlance.llm.mixing import BLOCK, CAP, SEED, SHARD_DOCS, SHARE, WEIGHTS
from parlance.llm.url_lists import CHANGES

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM w JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


_CHANGES = ", ".join(str(c) for c in CHANGES)

OP6 = rf"""
WITH changes(entry, action, day, category) AS (VALUES {_CHANGES}),
one AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY entry, day ORDER BY action DESC, category DESC) = 1),
turns AS (SELECT *, lag(action) OVER (PARTITION BY entry ORDER BY day) AS before FROM one),
spans AS (
  SELECT entry, action, day, category, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until
  FROM turns WHERE before IS NULL OR before <> action
),
captures AS (
  SELECT page_id, url, CAST(DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS VARCHAR) AS fetched_on,
         nullif(rtrim(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') AS host,
         regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]+/([^?#]*)', 1), '/+$', '') AS path
  FROM pages
),
found AS (
  SELECT c.page_id, s.entry, s.day AS listed_on, s.category
  FROM captures c JOIN spans s ON s.action = 'add' AND s.day <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
   AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry) OR starts_with(c.host || '/' || c.path || '/', s.entry || '/') AND contains(s.entry, '/'))
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.entry) DESC, s.entry DESC) = 1
)
SELECT c.page_id, c.host, c.fetched_on, f.entry, f.listed_on, f.category, f.entry IS NOT NULL AS blocked
FROM captures c LEFT JOIN found f USING (page_id)
"""


#: Sources of up to FAN shards, 256,000 documents: one level of shards.
OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), '{SEED}')) AS h
  FROM documents
),
named AS (
  SELECT source, sum(size)::BIGINT AS size, greatest(1, -(-count(*) // {SHARD_DOCS})) AS shards,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s
  FROM d GROUP BY source
),
weighted AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + s % {len(WEIGHTS)}] AS weight, (SELECT sum(size) FROM named) AS total FROM named),
filled AS (
  SELECT *, {CAP} * size / weight AS ratio,
         ({SHARE} * total - {CAP} * (sum(size) OVER w - size)) / sum(weight) OVER (ORDER BY {CAP} * size / weight DESC, s DESC ROWS UNBOUNDED PRECEDING) AS unit
  FROM weighted WINDOW w AS (ORDER BY {CAP} * size / weight, s ROWS UNBOUNDED PRECEDING)
),
rest AS (SELECT ({SHARE} * any_value(total) - {CAP} * coalesce(sum(size) FILTER (unit > ratio), 0)) / sum(weight) FILTER (unit <= ratio) AS unit FROM filled),
sources AS (
  SELECT f.s, f.source, f.size, f.shards, f.total, CAST(CASE WHEN f.unit > f.ratio THEN {CAP} * f.size ELSE r.unit * f.weight END AS DOUBLE) AS target
  FROM filled f, rest r
),
blocks AS (SELECT CAST(floor({SHARE} * total / {BLOCK} + 0.5) AS BIGINT) AS n FROM sources LIMIT 1),
source_seats AS (
  SELECT s, unnest(range(CAST(2 * target / {BLOCK} + 3 AS BIGINT))) AS k, target FROM sources WHERE target > 0
),
source_blocks AS (
  SELECT s, count(*) AS n FROM (SELECT s, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s, k) AS rank FROM source_seats), blocks WHERE rank <= blocks.n GROUP BY s
),
words AS (SELECT s.*, least(coalesce(b.n, 0) * {BLOCK}, {CAP} * s.size) AS words FROM sources s LEFT JOIN source_blocks b USING (s)),
dealt AS (
  SELECT d.doc_id, d.size, w.s, ('0x' || substr(d.h, 16, 15))::BIGINT % w.shards AS shard, ('0x' || substr(d.h, 1, 15))::BIGINT AS place, w.size AS source_size, w.target
  FROM d JOIN words w ON d.source IS NOT DISTINCT FROM w.source
),
shards AS (SELECT s, shard, sum(size)::BIGINT AS size FROM dealt GROUP BY s, shard),
shard_seats AS (SELECT s, shard, size, unnest(range({CAP} * size // {BLOCK})) AS k FROM shards WHERE size > 0),
shard_blocks AS (
  SELECT s, shard, count(*) AS n
  FROM (SELECT s, shard, row_number() OVER (PARTITION BY s ORDER BY size / (2 * k + 1) DESC, shard, k) AS rank FROM shard_seats) JOIN words USING (s)
  WHERE rank <= words.words // {BLOCK} GROUP BY s, shard
),
held AS (SELECT h.s, h.shard, h.size, coalesce(b.n, 0) * {BLOCK} AS held, {CAP} * h.size - coalesce(b.n, 0) * {BLOCK} AS room FROM shards h LEFT JOIN shard_blocks b USING (s, shard)),
shard_words AS (
  SELECT h.s, h.shard, h.size, h.held + greatest(0, least(h.room, w.words - sum(h.held) OVER (PARTITION BY h.s) - (sum(h.room) OVER (PARTITION BY h.s ORDER BY h.shard) - h.room))) AS words
  FROM held h JOIN words w USING (s)
),
runs AS (
  SELECT *, CASE WHEN size > 0 THEN words // size ELSE 0 END AS epochs, words - CASE WHEN size > 0 THEN words // size ELSE 0 END * size AS rest FROM shard_words
),
starts AS (SELECT *, {BLOCK} * (('0x' || substr(md5(concat_ws('|', s, shard, '{SEED}')), 1, 15))::BIGINT % ((size - rest) // {BLOCK} + 1)) AS start FROM runs),
ends AS (SELECT *, sum(size) OVER (PARTITION BY s, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM dealt)
SELECT e.doc_id, e.size, e.source_size, e.target,
       CAST(x.epochs * e.size + greatest(0, least(e.stop, x.start + x.rest) - greatest(e.stop - e.size, x.start)) AS BIGINT) AS taken
FROM ends e JOIN starts x USING (s, shard)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2, "op1_ngram_join": OP1, "op6_url_lists": OP6, "op3_exact_dedup": OP3}
