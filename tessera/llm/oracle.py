"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: The mix, step by step as in mixing.py: targets by water level, Sainte-Lague
#: seats, quotas per hash shard, and the circular run of blocks.
_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS i FROM sources
), weighted AS (
  SELECT *, CAST([3, 1, 2][CAST(i % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM ranked
), roomy AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS room, sum(source_size) OVER () * 1.5::DOUBLE AS want FROM weighted
), level AS (
  SELECT *, (want - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY room, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY room, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM roomy
), stop AS (
  SELECT level AS stop FROM level WHERE level <= room ORDER BY room, i LIMIT 1
), targets AS (
  SELECT source, source_size, n_docs, i, least(source_size * 2.0::DOUBLE, coalesce((SELECT stop FROM stop), 'inf'::DOUBLE) * weight) AS target FROM level
), seats AS (
  SELECT *, floor(target / 16 + 0.5) AS seats FROM targets
), missing AS (
  SELECT *, round(sum(target / 16) OVER ()) - sum(seats) OVER () AS miss FROM seats
), tried AS (
  SELECT i, miss, seats, target, k, CASE WHEN miss > 0 THEN target / (2 * (seats + k) + 1) ELSE -target / (2 * (seats - k) - 1) END AS quotient
  FROM missing, unnest(range(0, CAST(greatest(abs(miss), 1) AS BIGINT))) AS t(k)
  WHERE miss > 0 AND target > 0 OR miss < 0 AND seats - k > 0
), chosen AS (
  SELECT i, miss, row_number() OVER (ORDER BY quotient DESC, i) AS r FROM tried
), change AS (
  SELECT i, sum(sign(miss)) AS change FROM chosen WHERE r <= abs(miss) GROUP BY i
), plan AS (
  SELECT m.source, m.source_size, m.n_docs, m.i, m.target, CAST(seats + coalesce(change, 0) AS BIGINT) AS blocks FROM missing m LEFT JOIN change c ON m.i = c.i
), keyed AS (
  SELECT s.*, p.source_size, p.n_docs, p.i, p.target, p.blocks,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 8) AS BIGINT) AS key
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), lined AS (
  SELECT *, key % CAST(ceil(n_docs / 250.0) AS BIGINT) AS shard FROM keyed
), placed AS (
  SELECT *, CAST(sum(size) OVER w AS BIGINT) AS stop, CAST(sum(size) OVER (PARTITION BY i, shard) AS BIGINT) AS shard_size FROM lined
  WINDOW w AS (PARTITION BY i, shard ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), quotas AS (
  SELECT *, stop - size AS begin, least(CAST(floor(CAST(blocks * shard_size AS DOUBLE) / greatest(source_size, 1) + 0.5) AS BIGINT), 2 * shard_size // 16 + 1) AS quota FROM placed
), rounds AS (
  SELECT *, least(quota * 16, 2 * shard_size) AS words, greatest(CAST(ceil(shard_size / 16.0) AS BIGINT), 1) AS n_blocks FROM quotas
), runs AS (
  SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds,
    CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS rest,
    16 * (CAST('0x' || substr(md5('mix|' || i || '|' || shard), 1, 8) AS BIGINT) % n_blocks) AS origin FROM rounds
)
SELECT doc_id, size, source_size, target, CAST(rounds * size
  + greatest(least(stop, least(origin + rest, shard_size)) - greatest(begin, origin), 0)
  + greatest(least(stop, origin + rest - shard_size) - greatest(begin, 0), 0) AS BIGINT) AS taken
FROM runs
"""

ORACLE = {"op1_mix": _MIX}
