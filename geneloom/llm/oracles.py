"""DuckDB SQL for those queries whose result SQL can state."""

NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STRIPPED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER.format(f"trim(line, {STRIPPED})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, keeper IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

WORDS = "list_filter(regexp_split_to_array({}, '{}'), lambda x: x <> '')"
OP6 = f"""
WITH b AS (SELECT item_id, {WORDS.format(LOWER.format("coalesce(text, '')"), NOT_ALNUM)} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len(v) AS k, array_to_string(v, ' ') AS gram FROM (
 SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS v FROM b WHERE len(w) > 0) q),
d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"), NOT_ALNUM)} AS w FROM documents),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM g) ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, p.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM p) p JOIN g ON g.gram = p.gram AND g.k = p.k),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) q GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) q GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES: dict[str, str] = {"op5_line_dedup": OP5, "op6_decontaminate": OP6}

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT item_id, row_number() OVER () AS i, unnest({TERMS}) AS t FROM benchmark),
q AS (SELECT item_id, i, t, count(*)::BIGINT AS qf FROM i GROUP BY 1, 2, 3),
e AS (SELECT r, doc_id, len(w)::BIGINT AS k, unnest(w) AS t FROM d),
tf AS (SELECT r, doc_id, k, t, count(*)::BIGINT AS tf FROM e WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3, 4),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY 1),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
p AS (SELECT r, doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * k * n) // l))) AS part FROM tf JOIN w ON tf.t = w.t, s),
sc AS (SELECT item_id, i, r, doc_id, sum(qf * part)::BIGINT AS score FROM q JOIN p ON q.t = p.t GROUP BY 1, 2, 3, 4),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
