"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# Words are in ASCII lower case; sets of at most one word are the sequence itself. The pairs are those that
# share a shingle, so only links can be among them, and a recursion walks them.
_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+'
           ) AS w
    FROM documents
), sets AS (
    SELECT doc_id,
           CASE WHEN len(w) = 0 THEN []
                WHEN len(w) = 1 THEN [w[1]]
                ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
           END AS s
    FROM words
), shingles AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
    SELECT a AS doc_id, b AS other FROM links
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), smallest AS (
    SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(m.other, s.doc_id) AS kept
FROM sets s LEFT JOIN smallest m USING (doc_id)
"""



def _whole(components: int, scale: int) -> str:
    """Vectors without NULL, NaN or infinite components, scaled to integers."""
    length = f" AND len(embedding) = {components}" if components else ""
    return f"""
    SELECT vec_id, row_number() OVER () AS r,
           list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL{length}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"""


_TOP_K = f"""
WITH vectors AS MATERIALIZED ({_whole(0, 64)}),
scored AS (
    SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, c.r,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.r <> c.r
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 20
"""


def _rounds(rounds: int = 10, k: int = 8) -> str:
    """Every round spelled out: distances, the nearest centroid, and the floors of the means. Distances and means
    are far below 2^53, where doubles are exact."""
    steps = [
        f"vectors AS MATERIALIZED ({_whole(64, 1024)})",
        f"""c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v
    FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vectors ORDER BY h, v LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT x.r, x.vec_id, c.cluster, x.v,
           CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM vectors x CROSS JOIN c{i} c
    QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY distance, c.cluster) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.v, c.v) AS v
    FROM c{i} c LEFT JOIN (
        SELECT cluster, list(x ORDER BY d) AS v
        FROM (SELECT cluster, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
              FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i})
              GROUP BY cluster, d)
        GROUP BY cluster) m USING (cluster))"""
            )
    joined = ",\n".join(steps)
    return f"""
WITH {joined}
SELECT a.vec_id, a.cluster, a.distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


def _terms(table: str) -> str:
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    SELECT *, row_number() OVER () AS r,
           regexp_extract_all(coalesce({folded}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM {table}"""


_RANKED = f"""
WITH docs AS MATERIALIZED ({_terms("documents")}),
items AS MATERIALIZED ({_terms("benchmark")}),
facts AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
asked AS MATERIALIZED (SELECT r AS item, item_id, unnest(list_distinct(terms)) AS term FROM items),
held AS MATERIALIZED (
    SELECT r, doc_id, term, CAST(len(terms) AS BIGINT) AS n, count(*) AS tf
    FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked)
    GROUP BY ALL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM held, facts
    GROUP BY term, n_docs
),
scored AS (
    SELECT item, item_id, doc_id, r,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term), facts
    GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank,
       doc_id, score
FROM scored
WHERE score > 0
QUALIFY rank <= 10
"""

ORACLES = {
    "op5_near_duplicates": _NEAR_DUPLICATES,
    "op11_exact_top_k": _TOP_K,
    "op12_centroids": _rounds(),
    "op13_ranked_search": _RANKED,
}
