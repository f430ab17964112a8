"""Shared SQL fragments: the views of the ``embeddings`` table."""

from registry import fragment

fragment(
    "v",
    "SELECT vec_id, label, generate_subscripts(embedding, 1)::INTEGER AS i,"
    " unnest(embedding)::DOUBLE AS x FROM embeddings",
)
fragment("h", "SELECT vec_id, label, i, 1 + x AS x FROM v", "v")
fragment("labels2", "SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 2 END AS label FROM embeddings")
fragment("words", "SELECT label AS word_id, i, avg(x) AS x FROM h GROUP BY label, i", "h")
fragment(
    "word_dist",
    "SELECT h.vec_id, w.word_id,"
    " sum(CASE WHEN h.x + w.x <> 0 THEN (h.x - w.x) * (h.x - w.x) / (h.x + w.x) ELSE 0 END) / 2 AS dist"
    " FROM h JOIN words w ON h.i = w.i GROUP BY h.vec_id, w.word_id",
    "h",
    "words",
)
fragment(
    "scaled",
    "SELECT vec_id, word_id, (dist - min(dist) OVER p) / nullif(max(dist) OVER p - min(dist) OVER p, 0) AS weight"
    " FROM word_dist WINDOW p AS (PARTITION BY vec_id)",
    "word_dist",
)
fragment("postings", "SELECT word_id, vec_id, weight FROM scaled WHERE weight < 0.8", "scaled")
fragment(
    "queries",
    "SELECT word_id::BIGINT AS query_id, i, x, CASE WHEN word_id < 5 THEN 1 ELSE 2 END AS query_label FROM words",
    "words",
)
fragment(
    "query_dist",
    "SELECT q.query_id, w.word_id,"
    " sum(CASE WHEN q.x + w.x <> 0 THEN (q.x - w.x) * (q.x - w.x) / (q.x + w.x) ELSE 0 END) / 2 AS dist"
    " FROM queries q JOIN words w ON q.i = w.i GROUP BY q.query_id, w.word_id",
    "queries",
)
fragment(
    "query_words",
    "SELECT query_id, word_id, weight FROM (SELECT query_id, word_id, (dist - min(dist) OVER p)"
    " / nullif(max(dist) OVER p - min(dist) OVER p, 0) AS weight FROM query_dist"
    " WINDOW p AS (PARTITION BY query_id)) WHERE weight < 0.8",
    "query_dist",
)
fragment(
    "hits",
    "SELECT DISTINCT q.query_id, p.vec_id FROM query_words q JOIN postings p ON q.word_id = p.word_id",
    "query_words",
    "postings",
)
fragment(
    "scored",
    "SELECT t.query_id, t.vec_id,"
    " sum(CASE WHEN q.x + h.x <> 0 THEN (q.x - h.x) * (q.x - h.x) / (q.x + h.x) ELSE 0 END) / 2 AS dist"
    " FROM hits t JOIN queries q ON q.query_id = t.query_id JOIN h ON h.vec_id = t.vec_id AND h.i = q.i"
    " GROUP BY t.query_id, t.vec_id",
    "hits",
    "h",
)
fragment(
    "ranked",
    "SELECT s.query_id, CASE WHEN s.query_id < 5 THEN 1 ELSE 2 END AS query_label, s.rank, s.vec_id, s.dist,"
    " l.label AS hit_label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank"
    " FROM scored) s JOIN labels2 l ON l.vec_id = s.vec_id",
    "scored",
    "labels2",
)
fragment(
    "cum",
    "SELECT *, sum(CASE WHEN query_label = hit_label THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS matches FROM ranked",
    "ranked",
)
fragment(
    "k_grid",
    "SELECT unnest(list_concat(range(10, 101, 10), range(200, 5001, 100)))::INTEGER AS k",
)
fragment(
    "per_query",
    "SELECT e.query_id, k, c.query_label, c.matches / least(k, e.last) AS precision,"
    " c.matches / s.n AS recall,"
    " CASE WHEN 2 * c.matches > least(k, e.last) THEN c.query_label"
    " WHEN c.query_label = 1 THEN 2 ELSE 1 END AS vote"
    " FROM (SELECT query_id, max(rank) AS last FROM ranked GROUP BY query_id) e, k_grid"
    " JOIN cum c ON c.query_id = e.query_id AND c.rank = least(k, e.last)"
    " JOIN (SELECT label, count(*) AS n FROM labels2 GROUP BY label) s ON s.label = c.query_label",
    "cum",
    "k_grid",
)
