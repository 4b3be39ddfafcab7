"""The SQL of the near-duplicate queries: all pairs that share a shingle, and the components of the links."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def components_sql(words: int, kept: bool) -> str:
    """doc_id, n_shingles, component_id (and kept) from ``documents`` for shingles of so many words and a similarity of 0.8."""
    last = f", c.component_id = s.doc_id AS kept" if kept else ""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(n, 0) AS n_shingles FROM documents LEFT JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT s.doc_id, coalesce(min(node), s.doc_id) AS component_id FROM s LEFT JOIN r USING (doc_id) GROUP BY s.doc_id)
SELECT s.doc_id, s.n_shingles, c.component_id{last} FROM s JOIN c USING (doc_id)
"""
