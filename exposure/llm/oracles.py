"""SQL counterparts (DuckDB) of the queries that SQL can express on whole tables."""

from __future__ import annotations

# Lines are compared as texts here, not as hashes.
OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three
    FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM g) WHERE n > 1),
repeats AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
),
raw AS (SELECT r, doc_id, source, text, unnest(string_split(t, chr(10))) AS l FROM d WHERE text IS NOT NULL),
solid AS (SELECT r, doc_id, source, text, l FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM solid GROUP BY r),
lines AS (
    SELECT r, doc_id, coalesce(source, '') AS host, text, trim(regexp_replace(lower(l), '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g')) AS l
    FROM solid
),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM lines GROUP BY host),
common AS (
    SELECT lines.host, l, min(doc_id) AS first_id
    FROM lines JOIN hosts USING (host) GROUP BY lines.host, l, texts
    HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > 0.01 * texts
),
lost AS (
    SELECT r, sum(len(string_split(l, ' '))) AS n
    FROM lines JOIN common USING (host, l) WHERE doc_id IS DISTINCT FROM first_id GROUP BY r
),
base AS (
    SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
    FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.8 * n_words AS kept,
    n_removed_words::BIGINT AS n_removed_words
FROM base
"""

# The inversion is a running sum of probabilities; the order of the result doesn't show in a comparison of rows.
OP9 = r"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source),
rates AS (
    SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM sizes) * (SELECT sum(chars) FROM sizes)::DOUBLE / chars ELSE 1.0 END AS rate
    FROM sizes
),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
logs AS (
    SELECT source, rate, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p
    FROM steps
),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM logs),
edges AS (SELECT source, k, lag(upto, 1, 0.0) OVER (PARTITION BY source ORDER BY k) AS lo, upto AS hi FROM sums),
drawn AS (
    SELECT d.*, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT / 281474976710656.0 AS u
    FROM documents d
),
counted AS (
    SELECT drawn.*, k FROM drawn JOIN edges ON drawn.source IS NOT DISTINCT FROM edges.source AND u >= lo AND u < hi
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, k))::INTEGER AS "copy" FROM counted
"""

OP11 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
),
i AS (
    SELECT row_number() OVER () AS q, item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM benchmark
),
terms AS (SELECT DISTINCT q, item_id, unnest(ts) AS t FROM i),
size AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS length FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) SEMI JOIN terms USING (t) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // length AS m FROM d, size WHERE len(ts) > 0),
scores AS (
    SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM terms JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

# crc32 is a fold of bits over the decimal digits; ``lvl`` of the nodes above the subroots comes after all others.
OP13 = r"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, lang, coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS g,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS i, coalesce(strlen(text) || ':' || text, '-') AS t, n_chars,
        4294967295 - list_reduce(
            list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
            lambda a, b: list_reduce(
                list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
            )
        ) AS crc
    FROM documents
),
hashed AS (
    SELECT doc_id, lang, sha256(i || s || g || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN sha256(i || s || g || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || t) END AS changed
    FROM rows_
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
),
nodes(lang, lvl, pos, h, n) AS (
    SELECT lang, 0, pos, leaf, n FROM leaves
    UNION ALL
    SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
),
subroots AS (SELECT lang, lvl AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
    SELECT 0, pos, h, n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n
),
own AS (
    SELECT l.lang, l.pos, k.lvl, (l.pos >> k.lvl) AS at FROM leaves l JOIN nodes k ON l.lang IS NOT DISTINCT FROM k.lang AND k.pos = (l.pos >> k.lvl) AND k.n > 1
),
met AS (
    SELECT own.lang, own.pos, own.lvl, CASE WHEN x.h IS NULL THEN 'N' WHEN own.at % 2 = 1 THEN 'L' ELSE 'R' END AS side, coalesce(x.h, '') AS h
    FROM own LEFT JOIN nodes x ON own.lang IS NOT DISTINCT FROM x.lang AND own.lvl = x.lvl AND x.pos = xor(own.at, 1)
),
top_met AS (
    SELECT s.lang, k.lvl, CASE WHEN x.h IS NULL THEN 'N' WHEN (s.pos >> k.lvl) % 2 = 1 THEN 'L' ELSE 'R' END AS side, coalesce(x.h, '') AS h
    FROM subroots s JOIN tops k ON k.pos = (s.pos >> k.lvl) AND k.n > 1 LEFT JOIN tops x ON x.lvl = k.lvl AND x.pos = xor(s.pos >> k.lvl, 1)
),
every AS (
    SELECT lang, pos, lvl, side, h FROM met
    UNION ALL
    SELECT l.lang, l.pos, 1000 + t.lvl, side, h FROM leaves l JOIN top_met t ON l.lang IS NOT DISTINCT FROM t.lang
),
paths AS (SELECT lang, pos, string_agg(h, '' ORDER BY lvl) AS siblings, list(side || h ORDER BY lvl) AS steps FROM every GROUP BY lang, pos),
proofs AS (
    SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
        list_reduce(
            list_prepend(coalesce(l.changed, l.leaf), coalesce(p.steps, [])),
            lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)
        ) AS folded_root
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM proofs
"""

ORACLES = {"op1_line_frequency": OP1, "op9_poisson_mix": OP9, "op11_ball_tree": OP11, "op13_struct_rollup": OP13}
