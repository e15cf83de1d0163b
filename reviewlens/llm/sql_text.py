"""DuckDB SQL that computes, by plain means, what some of the queries return."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def groups_of_shingles(width: int, columns: str) -> str:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more."""
    return f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END
    ) AS gram FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
    SELECT doc_id, doc_id AS reached FROM documents
    UNION
    SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
), k AS (
    SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
), m AS (
    SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, {columns}
FROM k LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP9_SQL = groups_of_shingles(4, "k.doc_id = k.component_id AS kept")
OP11_SQL = groups_of_shingles(5, "coalesce(m.n_links, 0) AS n_links")

#: crc32 of a text of digits, bit by bit
_CRC = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(range(1, len(t) + 1), lambda i: [ascii(t[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""


def _encoded(*fields: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields
    ) + ")"


_HALVED = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT *, CAST(doc_id AS VARCHAR) AS t, {_encoded("doc_id", "source", "lang", "n_chars", "text")} AS leaf FROM documents
), leaves AS (
    SELECT doc_id, lang, leaf, coalesce('1' || lang, '0') AS g,
        CASE WHEN {_CRC} % 7 = 0 THEN {_encoded("doc_id", "source", "lang", "(n_chars + 1)", "text")} ELSE leaf END AS start,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM d
), lower_levels AS (
    SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY g
    UNION ALL
    SELECT g, level + 1, {_HALVED} FROM lower_levels WHERE len(nodes) > 1
), subroots AS (
    SELECT g, nodes[1] AS subroot, max(level) OVER () AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM lower_levels WHERE len(nodes) = 1
), upper_levels AS (
    SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, {_HALVED} FROM upper_levels WHERE len(nodes) > 1
), root AS (
    SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1
), steps AS (
    SELECT doc_id, level, (l.pos >> level) % 2 AS odd, coalesce(nodes[xor(l.pos >> level, 1) + 1], '') AS beside
    FROM leaves l JOIN lower_levels n USING (g) WHERE len(nodes) > 1
    UNION ALL
    SELECT doc_id, 1000 + level, (s.pos >> level) % 2, coalesce(nodes[xor(s.pos >> level, 1) + 1], '')
    FROM leaves l JOIN subroots s USING (g), upper_levels WHERE len(nodes) > 1
), path AS (
    SELECT doc_id, list(CASE WHEN odd = 1 THEN beside ELSE '' END ORDER BY level) AS before,
        list(CASE WHEN odd = 1 THEN '' ELSE beside END ORDER BY level) AS after FROM steps GROUP BY doc_id
), folded AS (
    SELECT doc_id, 1 AS step, start AS node FROM leaves
    UNION ALL
    SELECT f.doc_id, step + 1, sha256(before[step] || node || after[step]) FROM folded f JOIN path p ON p.doc_id = f.doc_id AND step <= len(before)
), ends AS (
    SELECT doc_id, arg_max(node, step) AS folded_root FROM folded GROUP BY doc_id
), proofs AS (
    SELECT doc_id, array_to_string(list_transform(range(1, len(before) + 1), lambda i: before[i] || after[i]), '') AS siblings FROM path
)
SELECT doc_id, lang, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (g) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), root
"""

OP13_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
    SELECT lang, phrase, len, count(*) AS f FROM (
        SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
        FROM w JOIN range(1, 6) lengths(len) ON len(w) >= len
    ) GROUP BY ALL HAVING count(*) >= 100
), c AS (
    SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE len > 1
), cuts AS (
    SELECT c.*, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM c JOIN range(1, 5) cut(k) ON k < len(words) JOIN totals USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM c WHERE c.lang = s.lang AND len(c.words) > len(s.words)
        AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * c.a >= 100 * s.a
    )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
