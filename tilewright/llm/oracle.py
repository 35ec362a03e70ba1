"""SQL of the language-model operators for DuckDB, where SQL can express them over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """WITH v AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS (SELECT vec_id, i, CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) AS e FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.e * b.e) AS BIGINT) AS score FROM q a JOIN q b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 2, 2))) AS i FROM w WHERE len(a) > 0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(a[i:i + 3], ' ')) AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""

SUBSTRINGS = rf"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM w WHERE len(a) >= 50),
s AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(a[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM s GROUP BY 1),
b AS MATERIALIZED (SELECT s.doc_id, s.i FROM s JOIN m ON m.h = s.h WHERE first < s.doc_id),
t AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word FROM w),
f AS (SELECT t.doc_id, t.i, t.word, max(CASE WHEN b.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.i = t.i),
k AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""

LINES = rf"""WITH r AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(a) + 1)) AS raw, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
l AS MATERIALIZED (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS ln, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t, len(regexp_extract_all(line, '{WORD}')) AS n FROM r WHERE regexp_matches(line, '{WORD}')),
x AS MATERIALIZED (SELECT a.doc_id, a.ln AS start, b.ln AS stop, sum(c.n) AS words, max(CASE WHEN c.ln = a.ln THEN c.n END) AS head, max(CASE WHEN c.ln = b.ln THEN c.n END) AS tail, string_agg(c.t, chr(10) ORDER BY c.ln) AS body FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.ln BETWEEN a.ln AND a.ln + 5 JOIN l c ON c.doc_id = a.doc_id AND c.ln BETWEEN a.ln AND b.ln GROUP BY 1, 2, 3),
q AS MATERIALIZED (SELECT * FROM x WHERE words >= 6 AND (words - tail < 6 OR words - head < 6)),
f AS (SELECT *, min(doc_id * 1000000 + start) OVER (PARTITION BY body) AS first FROM q),
g AS (SELECT DISTINCT l.doc_id, l.ln FROM l JOIN f ON f.doc_id = l.doc_id AND l.ln BETWEEN f.start AND f.stop WHERE f.first < f.doc_id * 1000000 + f.start),
k AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.raw) AS kept FROM r LEFT JOIN l ON l.doc_id = r.doc_id AND l.raw = r.raw LEFT JOIN g ON g.doc_id = l.doc_id AND g.ln = l.ln WHERE g.ln IS NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(z.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


def _level(name: str, keys: list[str], weight: str, above: str | None) -> str:
    """One level of the budget tree: shares of the parent's budget by weight, up to each node's capacity."""
    parent = keys[:-1]
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    link = " AND ".join(f"u.{k} = c.{k}" for k in parent) or "true"
    cols = ", ".join(keys)
    return f"""{name}0 AS (SELECT {', '.join('c.' + k for k in keys)}, cap, {weight} AS w, u.budget FROM (SELECT {cols}, CAST(sum(2 * total) AS DOUBLE) AS cap FROM leaves GROUP BY {cols}) c JOIN {above} u ON {link}),
{name}1 AS (SELECT *, cap / w AS r, (budget - coalesce(sum(cap) OVER ({by}ORDER BY cap / w, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by}ORDER BY cap / w, {keys[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}0),
{name} AS (SELECT {cols}, CASE WHEN r <= level THEN cap ELSE w * max(CASE WHEN r > level THEN level END) OVER ({by or ''}) END AS budget FROM {name}1)"""


MIX = rf"""WITH s AS MATERIALIZED (SELECT doc_id, 'd' || CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4 AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(regexp_extract_all(text, '{WORD}')) AS tokens FROM documents WHERE text IS NOT NULL),
leaves AS (SELECT domain, lang, source, sum(tokens) AS total FROM s WHERE tokens > 0 GROUP BY 1, 2, 3),
top AS (SELECT floor(CAST(sum(total) AS DOUBLE) * 0.8) AS budget FROM leaves),
{_level('a', ['domain'], '1.0::DOUBLE', 'top')},
{_level('b', ['domain', 'lang'], "CASE c.lang WHEN 'en' THEN 0.4::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'es' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END", 'a')},
{_level('c', ['domain', 'lang', 'source'], '1.0::DOUBLE', 'b')},
e AS (SELECT s.*, CAST(t.i AS INT) AS epoch, floor(c.budget + 1e-6) - t.i * l.total AS rest, coalesce(sum(tokens) OVER (PARTITION BY s.domain, s.lang, s.source, t.i ORDER BY md5('7-' || t.i || '-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s JOIN leaves l ON l.domain = s.domain AND l.lang = s.lang AND l.source = s.source JOIN c ON c.domain = s.domain AND c.lang = s.lang AND c.source = s.source, range(2) t(i) WHERE s.tokens > 0)
SELECT doc_id, domain, lang, source, tokens, epoch, CAST(start AS BIGINT) AS start FROM e WHERE rest > 0 AND start < rest"""


CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"

TRIE = f"""WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {CRC.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.i, t.k, t.size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i < c.h UNION ALL SELECT c.conv_id, t.i, t.k, t.size FROM c JOIN t USING (conv_id) WHERE t.i >= c.h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, k, size FROM r),
p AS MATERIALIZED (SELECT conv_id, d, size, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY 1),
u AS MATERIALIZED (SELECT n.path, up.path AS above FROM n JOIN p ON p.path = n.path AND p.conv_id = n.conv_id LEFT JOIN p up ON up.conv_id = n.conv_id AND up.d = n.depth - 1),
k AS (SELECT above AS path, count(*) AS n_children FROM u WHERE above IS NOT NULL GROUP BY 1),
s AS (SELECT a.path, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE k.path IS NULL) AS leaves FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN k ON k.path = n.path GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256 FROM n JOIN u ON u.path = n.path LEFT JOIN n up ON up.path = u.above LEFT JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": TOP_K,
        "op2_ngram_jaccard_join": JACCARD,
        "op4_substring_dedup": SUBSTRINGS,
        "op5_line_dedup": LINES,
        "op10_mixing_to_weights": MIX,
        "op13_conversation_trie": TRIE,
    }
