"""SQL counterparts of the registered queries, written for DuckDB from the rules themselves:
line by line and word by word, without the shortcuts of the Spark expressions."""

from __future__ import annotations

from exposure.functions.extract import PREFIXES
from exposure.functions.globs import HISTORY_NAMES, SUSPICIOUS_NAMES
from exposure.functions.text import HIGH_VALUE_KEYS, NOISE_WORDS
from exposure.operators.policy import CLAIMED_REASON, OUTSIDE_REASON
from queries.catalog import POLICY
from queries.tables import ENDINGS, FIRST_DAY, FOLDERS, HISTORY_FILES, LOW, REGFP, TAG
from exposure.params import Gate

DEFAULT = Gate()
# Unicode white space in RE2 notation.
SPACE = r"\x09\x0A\x0B\x0C\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def normalise(x: str, levels: int = 6) -> str:
    out = trim(x)
    for _ in range(levels):
        out = f"""regexp_replace({out}, '^(?:"(.*)"|''(.*)''|`(.*)`)$', '\\1\\2\\3', 's')"""
    return trim(out)


def after_eq(x: str) -> str:
    return f"substr({x}, strpos({x}, '=') + 1)"


def value_side(x: str) -> str:
    return f"CASE WHEN contains({x}, '=') THEN {normalise(after_eq(x))} ELSE {x} END"


def noise(x: str) -> str:
    return f"(strlen({x}) < 20 AND regexp_matches(lower({x}), '{'|'.join(NOISE_WORDS)}'))"


def entropies(name: str, source: str) -> str:
    """CTEs giving ``<name>(c, e)``: the entropy of each distinct ``c`` of ``source``."""
    return f"""
    {name}_c AS (SELECT DISTINCT c FROM {source}),
    {name}_ch AS (SELECT c, unnest(string_split(c, '')) AS x FROM {name}_c),
    {name}_n AS (SELECT c, x, count(*) AS k FROM {name}_ch WHERE x <> '' GROUP BY c, x),
    {name} AS (SELECT c, round(-sum(k / strlen(c)::DOUBLE * log2(k / strlen(c)::DOUBLE)), 9) AS e
               FROM {name}_n GROUP BY c)"""


def seeds(src: str, ids: str) -> str:
    shapes = ("[A-Za-z0-9+/=]{20,}", "[0-9a-fA-F]{32,}", "[A-Za-z0-9._-]{24,}")
    return " UNION ALL ".join(
        f"SELECT {ids}, unnest(regexp_extract_all(text, '{s}')) AS raw, true AS cut FROM {src}" for s in shapes
    )


def line_parts(src: str, ids: str) -> str:
    parts = []
    for p in PREFIXES:
        parts.append(
            f"SELECT {ids}, regexp_extract(substr(line, strpos(line, {lit(p)}) + {len(p)}), "
            f"'^[^{SPACE}\"'',;]*') AS raw, true AS cut FROM {src} WHERE contains(line, {lit(p)})"
        )
    parts.append(f"SELECT {ids}, {after_eq('line')} AS raw, false AS cut FROM {src} WHERE contains(line, '=')")
    parts.append(
        f"""SELECT {ids}, unnest(regexp_split_to_array(line, '[\\s"''=,:\\[\\]{{}}|;]+')) AS raw, false AS cut FROM {src}"""
    )
    return " UNION ALL ".join(parts)


def words(src: str, ids: str) -> str:
    return (
        f"SELECT {ids}, unnest(regexp_split_to_array(w, '[,:;]+')) AS raw, false AS cut FROM "
        f"(SELECT {ids}, unnest(regexp_split_to_array(text, '[{SPACE}]+')) AS w FROM {src}) WHERE NOT contains(w, '=')"
    )


def candidates(
    name: str, src: str, gate: Gate, ids: str = "tab, id", parts=("seeds", "lines", "words"), pairs: str | None = None
) -> str:
    """CTEs giving ``<name>(ids, c)`` from ``src(ids, text)``; ``pairs(ids, key, value)`` are the
    string values of those texts that are JSON."""
    raws = []
    if "seeds" in parts:
        raws.append(seeds(src, ids))
    if "lines" in parts:
        raws.append(line_parts(f"{name}_lines", ids))
    if "words" in parts:
        raws.append(words(src, ids))
    keyed = ""
    if pairs:
        raws.append(f"SELECT {ids}, value AS raw, true AS cut FROM {pairs}")
        keys = "|".join(HIGH_VALUE_KEYS)
        keyed = f"""
          UNION SELECT {ids}, c FROM (SELECT {ids}, {value_side('n')} AS c FROM (
            SELECT {ids}, {normalise('value')} AS n FROM {pairs} WHERE regexp_matches(lower(key), '{keys}')))
          WHERE strlen(c) >= {gate.min_len} AND NOT {noise('c')} AND replace(c, left(c, 1), '') <> ''"""
    return f"""
    {name}_lines AS (SELECT {ids}, {trim('line')} AS line FROM (
        SELECT {ids}, unnest(string_split(text, chr(10))) AS line FROM {src})),
    {name}_raw AS ({' UNION ALL '.join(raws)}),
    {name}_norm AS (SELECT DISTINCT {ids}, cut, {normalise('raw')} AS n FROM {name}_raw
                    WHERE strlen(raw) >= {gate.min_len}),
    {name}_val AS (SELECT DISTINCT {ids}, CASE WHEN cut THEN {value_side('n')} ELSE n END AS c FROM {name}_norm),
    {name}_gate AS (SELECT * FROM {name}_val WHERE strlen(c) >= {gate.min_len} AND NOT {noise('c')}),
    {entropies(name + '_ent', name + '_gate')},
    {name} AS (SELECT DISTINCT {ids}, c FROM {name}_gate JOIN {name}_ent USING (c) WHERE e >= {gate.min_entropy}
               {keyed})"""


TEXTS = """texts AS (SELECT 'documents' AS tab, doc_id AS id, text FROM documents
                     UNION ALL SELECT 'pages', page_id, html FROM pages)"""
DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
PAGES = "pgs AS (SELECT page_id AS id, html AS text FROM pages)"
DOC_C = f"{DOCS}, {candidates('doc_c', 'docs', LOW, 'id')}"
PAGE_C = f"{PAGES}, {candidates('page_c', 'pgs', LOW, 'id')}"
DOC_PAIRS = f"""{DOC_C}, doc_pairs AS (
    SELECT sha256(c) AS hash, left(sha256('/home/u/' || lang || '/' || source), 16) AS project_id,
           {FIRST_DAY} + id AS seen_s FROM doc_c JOIN documents ON doc_id = id)"""
PAGE_PAIRS = f"""{PAGE_C}, page_pairs AS (
    SELECT sha256(c) AS hash, left(sha256(regexp_extract(url, '^https?://([^/]*)', 1)), 16) AS project_id,
           {FIRST_DAY} + id AS seen_s FROM page_c JOIN pages ON page_id = id)"""
BOTH = f"""{DOC_PAIRS}, {PAGE_PAIRS}, both_pairs AS (
    SELECT hash, project_id, max(seen_s) AS seen_s
    FROM (SELECT * FROM doc_pairs UNION ALL SELECT * FROM page_pairs) GROUP BY hash, project_id)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


ORACLES: dict[str, str] = {}

# --- extraction -------------------------------------------------------------------------------


def _hits(src: str, ids: str, min_len: int, min_entropy: float, name: str = "hit") -> str:
    """CTEs giving ``<name>(ids, hits)`` for texts with at least one hit."""
    return f"""
    {name}_m AS (SELECT DISTINCT {ids}, raw AS c FROM ({seeds(src, ids)}) WHERE strlen(raw) >= {min_len}),
    {entropies(name + '_e', name + '_m')},
    {name} AS (SELECT {ids}, count(*) AS hits FROM {name}_m JOIN {name}_e USING (c)
               WHERE e >= {min_entropy} GROUP BY {ids})"""


ORACLES["high_entropy_hits"] = with_(
    f"{TEXTS}, {_hits('texts', 'tab, id', 12, 3.0)}",
    "SELECT t.tab, t.id, coalesce(hits, 0) AS hits FROM texts t LEFT JOIN hit USING (tab, id)",
)
ORACLES["entropy_tokens"] = with_(
    f"""t AS (SELECT DISTINCT c FROM (
            SELECT unnest(regexp_split_to_array(html, '[\\s"''=,:\\[\\]{{}}|;]+')) AS c FROM pages)
            WHERE length(c) >= 16), {entropies('ent', 't')}""",
    "SELECT sha256(c) AS hash, e AS entropy FROM ent",
)
ORACLES["normalised_values"] = with_(
    """f AS (SELECT page_id, regexp_extract_all(html, '=([^ <>]*)', 1) AS a FROM pages),
       g AS (SELECT page_id, unnest(range(len(a)))::INTEGER AS n, unnest(a) AS raw FROM f)""",
    f"""SELECT page_id, n, sha256({normalise('raw')}) AS normalised, sha256({value_side('raw')}) AS value_side
        FROM g""",
)
for _name, _parts, _gate in (
    ("candidates_seeded", ("seeds",), LOW),
    ("candidates_lines", ("lines",), LOW),
    ("candidates_words", ("words",), LOW),
    ("candidates_default", ("seeds", "lines", "words"), DEFAULT),
    ("candidates_low_entropy", ("seeds", "lines", "words"), LOW),
):
    ORACLES[_name] = with_(
        f"{TEXTS}, {candidates('cand', 'texts', _gate, parts=_parts)}", "SELECT tab, id, sha256(c) AS hash FROM cand"
    )
ORACLES["json_candidates"] = with_(
    f"""k AS (SELECT c_custkey AS id, c_name, c_mktsegment AS seg, md5(c_name) AS code FROM customer),
        pairs AS (
          SELECT 'customer' AS tab, id, 'name' AS key, c_name AS value FROM k
          UNION ALL SELECT 'customer', id, 'my_Password', seg || '-' || id FROM k
          UNION ALL SELECT 'customer', id, 'hint', code || upper(code) FROM k
          UNION ALL SELECT 'customer', id, '', code || seg FROM k
          UNION ALL SELECT 'customer', id, 'env', 'KEY=' || upper(code) || seg FROM k),
        nothing AS (SELECT tab, id, '' AS text FROM pairs WHERE false),
        {candidates('cand', 'nothing', DEFAULT, pairs='pairs')}""",
    "SELECT tab, id, sha256(c) AS hash FROM cand",
)

# --- registry ---------------------------------------------------------------------------------

ORACLES["registry_build"] = with_(BOTH, "SELECT hash, project_id, seen_s FROM both_pairs")
ORACLES["registry_entries"] = with_(
    BOTH,
    """SELECT hash, 0 AS page, string_agg(project_id, ',' ORDER BY project_id) AS projects,
              count(*) AS n_projects, max(seen_s) AS last_seen_s FROM both_pairs GROUP BY hash""",
)
ORACLES["registry_hashes"] = with_(BOTH, "SELECT DISTINCT hash FROM both_pairs")
_PER_HASH = "per_hash AS (SELECT hash, count(*) AS n FROM both_pairs GROUP BY hash)"
ORACLES["registry_snapshot"] = with_(
    f"{BOTH}, {_PER_HASH}",
    """SELECT count(*) AS tracked_hashes, count(*) FILTER (n > 1) AS duplicate_hashes,
              'completed' AS scan_state FROM per_hash""",
)
ORACLES["registry_fingerprint"] = with_(
    f"""{BOTH}, b AS (SELECT left(hash, 3) AS bucket, sha256(string_agg(hash, '' ORDER BY hash)) AS fp
                      FROM (SELECT DISTINCT hash FROM both_pairs) GROUP BY 1)""",
    """SELECT CASE WHEN count(*) = 0 THEN '0'
              ELSE left(sha256(string_agg(bucket || fp, '' ORDER BY bucket)), 16) END AS regfp FROM b""",
)
ORACLES["duplicates"] = with_(
    f"{BOTH}, {_PER_HASH}, meta AS (SELECT DISTINCT left(sha256('/home/u/' || lang || '/' || source), 16) AS project_id, "
    "lang || '/' || source AS name FROM documents WHERE lang <> 'es')",
    """SELECT b.hash, b.project_id, coalesce(name, '.../' || b.project_id) AS display_name, n AS n_projects
       FROM both_pairs b JOIN per_hash USING (hash) LEFT JOIN meta m ON m.project_id = b.project_id WHERE n > 1""",
)
ORACLES["duplicate_count"] = with_(f"{BOTH}, {_PER_HASH}", "SELECT count(*) FILTER (n > 1) AS duplicates FROM per_hash")
_HASH_PROJECTS = "SELECT DISTINCT hash, project_id FROM doc_pairs WHERE hash IN (SELECT hash FROM page_pairs)"
ORACLES["hash_projects"] = with_(f"{DOC_PAIRS}, {PAGE_PAIRS}", _HASH_PROJECTS)
ORACLES["check_hash"] = with_(
    f"""{DOC_PAIRS}, {PAGE_PAIRS}, asked AS (
          SELECT upper(hash) AS hash_hex FROM doc_pairs UNION ALL SELECT 'zz' || substr(hash, 3) FROM doc_pairs
          UNION ALL SELECT sha256(c_name) FROM customer UNION ALL SELECT hash FROM page_pairs)""",
    """SELECT hash_hex, length(hash_hex) = 64 AND regexp_full_match(hash_hex, '[0-9a-fA-F]+')
              AND lower(hash_hex) IN (SELECT hash FROM doc_pairs) AS known FROM asked""",
)
ORACLES["clear_source"] = with_(
    DOC_PAIRS,
    """SELECT hash, count(DISTINCT project_id) AS n_projects FROM doc_pairs
       WHERE project_id <> left(sha256('/home/u/en/src2'), 16) GROUP BY hash""",
)
ORACLES["registry_remove"] = with_(
    f"{DOC_PAIRS}, {PAGE_PAIRS}",
    f"SELECT DISTINCT hash, project_id FROM doc_pairs EXCEPT ({_HASH_PROJECTS})",
)
ORACLES["registry_changes"] = with_(
    f"{DOC_PAIRS}, {PAGE_PAIRS}",
    """SELECT 'added' AS change, hash FROM (SELECT hash FROM page_pairs EXCEPT SELECT hash FROM doc_pairs)
       UNION ALL SELECT 'removed', hash FROM (SELECT hash FROM doc_pairs EXCEPT SELECT hash FROM page_pairs)""",
)
def _state(name: str, source: str) -> str:
    lanes = ", ".join(f"sum(('0x' || substr(sha256('set:' || hash), {8 * i + 1}, 8))::BIGINT) % 4294967296" for i in range(8))
    return f"""{name} AS (SELECT CASE WHEN count(*) = 0 THEN '0' ELSE left(sha256(array_to_string(
            [count(*)::VARCHAR] || [x::VARCHAR FOR x IN [{lanes}]], ':')), 16) END AS regfp FROM (SELECT DISTINCT hash FROM {source}))"""


ORACLES["registry_set_fingerprint"] = with_(
    f"{PAGE_PAIRS}, {_state('st', 'page_pairs')}", "SELECT way, regfp FROM st, (SELECT unnest(['whole', 'followed']) AS way)"
)
_VAULT = """vault AS (
    SELECT c_custkey, 0 AS item_no, 'pw-' || c_name AS v FROM customer
    UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer WHERE strlen(c_mktsegment) > 8
    UNION ALL SELECT c_custkey, 3, md5(c_name) FROM customer
    UNION ALL SELECT c_custkey, 5, 'top-' || c_nationkey FROM customer)"""
ORACLES["vault_items"] = with_(
    _VAULT, "SELECT c_custkey, item_no, sha256(v) AS hash FROM vault WHERE NOT contains(v, 'HOUSE')"
)
ORACLES["rescan_delta"] = with_(
    f"""{DOC_PAIRS}, {PAGE_PAIRS}, {_VAULT},
        v AS (SELECT sha256(v) AS hash FROM vault WHERE NOT contains(v, 'HOUSE')),
        c AS (SELECT 'documents' AS source, hash FROM doc_pairs UNION ALL SELECT 'pages', hash FROM page_pairs
              UNION ALL SELECT 'vault', hash FROM v)""",
    """SELECT 'registry' AS stage, NULL::VARCHAR AS source, (SELECT count(DISTINCT hash) FROM doc_pairs) AS before,
              (SELECT count(DISTINCT hash) FROM c) AS after, NULL::BIGINT AS hashes
       UNION ALL SELECT 'collect', source, NULL, NULL, count(*) FROM c GROUP BY source""",
)

# --- sources ----------------------------------------------------------------------------------

_KEY_IGNORED = """(k IN ('PATH','HOME','PWD','USER','SHELL','TERM','LANG','EDITOR','VISUAL','PAGER','COLORTERM',
    'DISPLAY','DESKTOP_SESSION','MORE','PS1','PS2','HISTSIZE','NODE_ENV','DEBUG')
    OR regexp_matches(k, '^(LC_|XDG_|DBUS_|GNOME_|KDE_|SSH_|GPG_|LESS|PROMPT|HIST|LOG_|BUILD_|CI_|TEST_)')
    OR k LIKE '%\\_NONSECRET' ESCAPE '\\')"""


def _env(src: str, ids: str) -> str:
    """CTEs giving ``env(ids, line_no, k, v)`` from ``src(ids, text)``."""
    return f"""
    env_l AS (SELECT {ids}, unnest(range(len(a)))::INTEGER AS line_no, {trim('unnest(a)')} AS line FROM (
        SELECT {ids}, string_split(text, chr(10)) AS a FROM {src})),
    env AS (SELECT * FROM (
        SELECT {ids}, line_no, {trim("split_part(line, '=', 1)")} AS k,
               regexp_replace({trim(after_eq('line'))}, '^["'']+|["'']+$', '', 'g') AS v
        FROM env_l WHERE contains(line, '=') AND NOT starts_with(line, '#')) WHERE v <> '' AND NOT {_KEY_IGNORED})"""


ORACLES["env_pairs"] = with_(
    f"{TEXTS}, {_env('texts', 'tab, id')}",
    "SELECT tab, id, line_no, sha256(k) AS key_hash, sha256(v) AS hash FROM env",
)


def choose(values, index: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], ({index} % {len(values)} + 1)::INTEGER)"


_DIR = f"'/home/u/' || lang || '/' || source || '/' || {choose(FOLDERS, 'doc_id')}"
PATHS = f"""paths AS (SELECT *, dir || '/' || name AS path FROM (
    SELECT doc_id, lang, source, text, {_DIR} AS dir, 'f' || doc_id || {choose(ENDINGS, '(doc_id // 3)')} AS name
    FROM documents))"""
_CODE = "md5(source) || upper(md5(source))"
FILES = f"""{PATHS}, files AS (
    SELECT *, CASE
        WHEN name LIKE '%.json' THEN '{{"encrypted":false,"items":[{{"login":{{"password":"' || {_CODE} || '"}},"notes":"'
             || replace(replace(text, '"', '\\"'), chr(10), '\\n') || '"}}]}}'
        WHEN name LIKE '%\\_export.csv' ESCAPE '\\' THEN '"username","password"' || chr(10) || text
        WHEN name LIKE '%.csv' THEN 'name,login,password' || chr(10) || 'a,b,' || {_CODE} || chr(10) || text
        WHEN name LIKE '%.1pif' THEN '"password" ' || {_CODE} || chr(10) || text
        ELSE text END AS content FROM paths)"""
ORACLES["env_registry"] = with_(
    f"{FILES}, src AS (SELECT doc_id AS id, content AS text FROM files), {_env('src', 'id')}",
    "SELECT DISTINCT sha256(v) AS hash, left(sha256(dir), 16) AS project_id FROM env JOIN files ON doc_id = id",
)
ORACLES["key_filter"] = """
    SELECT c_custkey, key, (key LIKE 'Customer#00%' OR key LIKE '%7' OR key LIKE 'A%E' OR key = 'BUILDING'
                            OR key LIKE 'P%G') AS ignored
    FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS key FROM customer)"""
ORACLES["vault_detect"] = with_(
    f"""k AS (SELECT *, md5(c_name) || upper(md5(c_name)) AS code, c_nationkey % 7 = 0 AS enc,
                    c_nationkey % 5 = 0 AS emp FROM customer),
        v AS (SELECT c_custkey, code AS c FROM k UNION ALL SELECT c_custkey, c_name FROM k
              UNION ALL SELECT c_custkey, c_mktsegment || code FROM k UNION ALL SELECT c_custkey, code FROM k),
        {entropies('ent', 'v')}, h AS (SELECT c_custkey, count(*) FILTER (e >= 4.0 AND strlen(c) >= 8) AS hits
                                       FROM v JOIN ent USING (c) GROUP BY 1)""",
    """SELECT c_custkey, (CASE WHEN enc OR emp THEN 0 ELSE hits END)::INTEGER AS hits,
              CASE WHEN enc THEN false WHEN emp THEN c_nationkey % 2 = 0 ELSE true END AS is_export
       FROM k JOIN h USING (c_custkey)""",
)
ORACLES["export_detectors"] = with_(
    f"""f AS (SELECT doc_id, doc_id % 7 AS kind, list_extract(['login,password' || chr(10),
            'Login,Password,bitwarden' || chr(10), 'dashlane' || chr(10), '"username","password"' || chr(10),
            'OnePassword ' || {_CODE} || chr(10), 'x.1pif login password ' || {_CODE} || chr(10),
            {_CODE} || chr(10)], (doc_id % 7 + 1)::INTEGER) || text AS text FROM documents),
        src AS (SELECT doc_id AS id, text FROM f), {_hits('src', 'id', 12, 4.0)},
        j AS (SELECT doc_id, lower(text) AS t, text, coalesce(hits, 0) AS h FROM f LEFT JOIN hit ON id = doc_id),
        s AS (SELECT *, contains(t, 'password') AND contains(t, 'login') AS csv, contains(t, 'dashlane') AS named,
                     contains(t, '"username"') AND contains(t, '"password"') AS quoted,
                     contains(text, '.1pif') OR contains(t, 'onepassword') OR contains(text, '"password"') AS pif FROM j)""",
    """SELECT doc_id, (CASE WHEN csv THEN h ELSE 0 END)::INTEGER AS csv_hits,
              csv AND (h > 0 OR contains(t, 'bitwarden')) AS csv_export,
              (CASE WHEN named OR quoted THEN h ELSE 0 END)::INTEGER AS dash_hits,
              (named OR quoted) AND (h > 0 OR named) AS dash_export,
              (CASE WHEN pif THEN h ELSE 0 END)::INTEGER AS pif_hits, pif AND h > 0 AS pif_export FROM s""",
)

# --- paths ------------------------------------------------------------------------------------

ORACLES["masked_location"] = with_(
    PATHS,
    "SELECT doc_id, lang || '/' || name AS inside, 'home/' || name AS outside, name AS bare FROM paths",
)
ORACLES["display_name"] = with_(
    PATHS,
    f"""SELECT doc_id, source || '/' || {choose(FOLDERS, 'doc_id')} AS name,
               '.../' || source || '/' || {choose(FOLDERS, 'doc_id')} AS fallback, left(sha256(dir), 16) AS project_id,
               left(sha256('logical:' || {choose(FOLDERS, 'doc_id')}), 16) AS logical_id FROM paths""",
)
ORACLES["glob_match"] = with_(
    f"{PATHS}, n AS (SELECT doc_id, {choose(FOLDERS, 'doc_id')} || '/' || name AS full_name, name FROM paths)",
    """SELECT doc_id, name LIKE '%.txt' AS p0, contains(name, '_creds') AS p1,
              name LIKE 'f1%' OR full_name LIKE 'f1%' AS p2, regexp_matches(name, '^f.2') AS p3,
              contains(name, 'password') AS p4, regexp_matches(name, '^f[3-5].*\\.csv$') AS p5, false AS p6,
              starts_with(name, '.env') AS p7 FROM n""",
)
_MARKS = " OR ".join(f"contains(l, {lit(m)})" for m in SUSPICIOUS_NAMES)
ORACLES["suspicious_names"] = f"""
    SELECT doc_id, CASE WHEN {_MARKS} THEN CASE WHEN l LIKE '%.json' THEN 'bitwarden_json'
        WHEN l LIKE '%.csv' THEN 'bitwarden_csv' WHEN l LIKE '%.1pif' THEN 'onepassword_1pif'
        ELSE 'suspicious_filename' END END AS format
    FROM (SELECT doc_id, lower('F' || doc_id || upper({choose(ENDINGS, 'doc_id')})) AS l FROM documents)"""
_LIVE = ", ".join(lit(h) for h in HISTORY_NAMES)
_STEM = " OR ".join(
    f"((starts_with(l, {lit(h)}) OR contains(l, {lit(h.lstrip('.'))})) AND "
    f"(regexp_matches(l, '\\.old|\\.bak|\\.backup|\\.orig|~$') OR regexp_matches(n, '{h.replace('.', chr(92) + '.')}\\.[0-9][^/]*$')))"
    for h in HISTORY_NAMES
)
_ROTATED = f"({_STEM} OR (contains(l, 'history') AND regexp_matches(l, '\\.old|\\.bak|\\.1|~$')))"
ORACLES["history_names"] = f"""
    SELECT doc_id, n IN ({_LIVE}) OR {_ROTATED} AS is_history, {_ROTATED} AS rotated
    FROM (SELECT doc_id, {choose(HISTORY_FILES, 'doc_id')} AS n, lower({choose(HISTORY_FILES, 'doc_id')}) AS l
          FROM documents)"""
ORACLES["history_targets"] = f"""
    SELECT DISTINCT dir || '/' || n AS path FROM (
        SELECT lang, source, {_DIR} AS dir, {choose(HISTORY_FILES, '(doc_id // 2)')} AS n,
               lower({choose(HISTORY_FILES, '(doc_id // 2)')}) AS l FROM documents)
    WHERE (lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND (n IN ({_LIVE}) OR {_ROTATED}))
       OR dir || '/' || n IN ('/home/u/de/src6/app/notes.txt', '/home/u/en/src6/docs/notes.txt')"""
# The rules of each language directory spelled out: the last one that applies decides, and an
# ignored directory hides what is below it.
_IGNORED = """CASE lang
        WHEN 'en' THEN folder IN ('docs', 'logs') OR source = 'src3'
             OR (name LIKE '%.1pif' AND name NOT LIKE 'f10%')
        WHEN 'de' THEN (source ~ 'src1.' AND folder = 'app')
             OR regexp_full_match(name, 'f[0-4].*\\.txt')
             OR (folder = 'notes' AND name NOT LIKE 'f2%')
        WHEN 'fr' THEN folder = 'logs' OR (source = 'src7' AND folder = 'docs')
             OR (name LIKE '%.csv' AND name NOT LIKE '%\\_export.csv' ESCAPE '\\')
        ELSE false END"""
ORACLES["ignore_rules"] = with_(
    f"{PATHS}, p AS (SELECT *, {choose(FOLDERS, 'doc_id')} AS folder FROM paths)",
    f"SELECT doc_id, {_IGNORED} AS ignored FROM p",
)
_FOUND = f"""{FILES}, p AS (SELECT *, {choose(FOLDERS, 'doc_id')} AS folder FROM files),
    found AS (SELECT doc_id, dir, content FROM p WHERE lang IN ('en', 'de', 'fr') AND folder NOT IN ('node_modules', 'build')
        AND (name LIKE '%.txt' OR name LIKE '%.env' OR name LIKE '%.md') AND NOT {_IGNORED}),
    src AS (SELECT doc_id AS id, content AS text FROM found), {_env('src', 'id')}"""
ORACLES["discovery_registry"] = with_(
    _FOUND, "SELECT DISTINCT sha256(v) AS hash, left(sha256(dir), 16) AS project_id FROM env JOIN found ON doc_id = id"
)
ORACLES["discovery_sources"] = with_(
    _FOUND, "SELECT DISTINCT sha256(v) AS hash, left(sha256('logical:env'), 16) AS project_id FROM env"
)
ORACLES["discovery_projects"] = with_(
    _FOUND,
    """SELECT DISTINCT left(sha256(dir), 16) AS project_id,
           list_extract(string_split(dir, '/'), -2) || '/' || list_extract(string_split(dir, '/'), -1) AS display_name FROM found""",
)
_READ = _FOUND.replace("WHERE lang IN ('en', 'de', 'fr') AND folder", "WHERE source <> 'src5' AND lang IN ('en', 'de', 'fr') AND folder")
_ERRORS = """errs AS (SELECT 'env' AS source, 'PermissionError: ' || folder AS error, count(*) AS n FROM p
        WHERE source = 'src5' AND lang IN ('en', 'de', 'fr') GROUP BY ALL
      UNION ALL SELECT 'broken', 'no listing configured', 1)"""
ORACLES["rescan_errors"] = with_(f"{_READ}, {_ERRORS}", "SELECT * FROM errs")
ORACLES["rescan_from_corpus"] = with_(
    f"""{_READ}, {_ERRORS}, {DOC_PAIRS}, {PAGE_PAIRS}, {_VAULT},
        c AS (SELECT 'env' AS source, sha256(v) AS hash FROM env UNION ALL SELECT 'pages', hash FROM page_pairs
              UNION ALL SELECT 'vault', sha256(v) FROM vault WHERE NOT contains(v, 'HOUSE')),
        old AS (SELECT DISTINCT hash FROM doc_pairs), new AS (SELECT DISTINCT hash FROM c)""",
    """SELECT 'registry' AS stage, NULL::VARCHAR AS source, (SELECT count(*) FROM old) AS before, (SELECT count(*) FROM new) AS after,
              NULL::BIGINT AS hashes, (SELECT count(*) FROM new WHERE hash NOT IN (FROM old)) AS added,
              (SELECT count(*) FROM old WHERE hash NOT IN (FROM new)) AS removed, NULL::VARCHAR AS error, NULL::VARCHAR AS state
       UNION ALL SELECT 'collect', s, NULL, NULL, (SELECT count(*) FROM c WHERE source = s), NULL, NULL, NULL, NULL
       FROM (SELECT unnest(['env', 'pages', 'vault']) AS s)
       UNION ALL SELECT 'errors', source, NULL, NULL, n, NULL, NULL, error, NULL FROM errs
       UNION ALL SELECT 'state', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
              CASE WHEN (SELECT count(*) FROM errs) > 0 THEN 'failed' ELSE 'completed' END""",
)
_CLAIMED = """((lang = 'en' OR (lang = 'fr' AND source = 'src1')) AND
    (name LIKE '.env%' OR name LIKE '%.env' OR (name LIKE 'f1%' AND name LIKE '%.txt')))"""
_ON_DE = """(lang = 'de' AND (name LIKE '%.json' OR contains(name, '_creds') OR starts_with(source, 'src1')))"""
_REASON = f"""CASE WHEN {_CLAIMED} THEN {lit(CLAIMED_REASON)} WHEN lang = 'en' THEN 'under /home/u/en'
    WHEN {_ON_DE} THEN 'under /home/u/de' WHEN lang = 'es' THEN 'under /home/u/es' ELSE {lit(OUTSIDE_REASON)} END"""
ORACLES["path_policy"] = with_(
    PATHS, f"SELECT doc_id, starts_with(r, 'under ') AS treat, r AS reason FROM (SELECT doc_id, {_REASON} AS r FROM paths)"
)
_SKIP = "(" + ", ".join(lit(s) for s in POLICY.skip_dirs) + ")"
ORACLES["skipped_dirs"] = with_(
    PATHS, f"SELECT doc_id, {choose(FOLDERS, 'doc_id')} IN {_SKIP} AS skipped FROM paths"
)
ORACLES["claimed_files"] = with_(
    PATHS,
    """SELECT DISTINCT path FROM paths WHERE lang = 'en'
       AND (name LIKE '%.env' OR regexp_matches(name, '^f.0') OR name LIKE '%\\_creds.json' ESCAPE '\\')""",
)
ORACLES["file_gate"] = """
    WITH f AS (SELECT doc_id, unhex(list_extract(['', '89504E470D0A1A0A', 'FFD8FFE0', '504B0304', '53514C697465', '00',
                  '41000000', '410000'], (doc_id % 8 + 1)::INTEGER))
                  || encode(text) AS content FROM documents),
         h AS (SELECT doc_id, octet_length(content) AS size, left(hex(content), 32) AS hx FROM f)
    SELECT doc_id, size, size >= 1
           AND NOT regexp_matches(hx, '^(00|89504E47|FFD8|504B|53514C697465)')
           AND len(list_filter(range(16), lambda i: substr(hx, (2 * i + 1)::INTEGER, 2) = '00')) <= 2 AS is_text FROM h"""

# --- known secrets ----------------------------------------------------------------------------

ORACLES["known_in_documents"] = with_(
    f"{DOC_C}, {PAGE_C}",
    """SELECT d.doc_id, count(k.c) AS known FROM documents d LEFT JOIN
       (SELECT id, c FROM doc_c WHERE c IN (SELECT c FROM page_c)) k ON k.id = d.doc_id GROUP BY d.doc_id""",
)
ORACLES["known_measured"] = ORACLES["known_in_documents"]
ORACLES["known_in_pages"] = with_(
    f"{DOC_C}, {PAGE_C}",
    """SELECT p.page_id, count(k.c) AS known FROM pages p LEFT JOIN
       (SELECT id, c FROM page_c WHERE c IN (SELECT c FROM doc_c)) k ON k.id = p.page_id GROUP BY p.page_id""",
)
ORACLES["known_hits"] = with_(
    f"{DOC_C}, {PAGE_C}",
    """SELECT 'documents' AS tab, id, sha256(c) AS hash FROM doc_c
       UNION ALL SELECT 'pages', id, sha256(c) FROM page_c WHERE c IN (SELECT c FROM doc_c)""",
)
ORACLES["output_check"] = with_(
    f"{DOC_C}, {PAGE_C}",
    """SELECT p.page_id AS capture_id, CASE WHEN p.page_id % 3 <> 0 THEN 'ok' ELSE 'error' END AS status,
              count(k.c) AS secrets_found FROM pages p LEFT JOIN
       (SELECT id, c FROM page_c WHERE c IN (SELECT c FROM doc_c)) k ON k.id = p.page_id GROUP BY p.page_id""",
)


def replaced(text: str, values: str) -> str:
    return f"list_reduce(list_concat([{text}], {values}), lambda a, v: replace(a, v, '[REDACTED]'))"


ORACLES["redact_texts"] = with_(
    f"{DOC_C}, v AS (SELECT id, list(c ORDER BY c) AS vs FROM doc_c GROUP BY id)",
    f"""SELECT doc_id, sha256(CASE WHEN vs IS NULL THEN text ELSE {replaced('text', 'vs')} END) AS text_hash,
               coalesce(len(vs), 0)::INTEGER AS secrets FROM documents LEFT JOIN v ON id = doc_id""",
)

# --- residue ----------------------------------------------------------------------------------

_EXAMINED = f"""{FILES}, ex AS (
    SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS surface_no FROM (
        SELECT *, {_REASON} AS r FROM files WHERE {choose(FOLDERS, 'doc_id')} NOT IN {_SKIP}) WHERE starts_with(r, 'under '))"""
_RESIDUE = f"""{_EXAMINED},
    src AS (SELECT doc_id AS id, content AS text FROM ex WHERE strlen(content) >= 1),
    notes AS (SELECT doc_id AS id, text FROM ex WHERE name LIKE '%.json'),
    {_hits('src', 'id', 12, 4.0, 'ghit')}, {_hits('notes', 'id', 16, 4.0, 'nhit')},
    pw AS (SELECT DISTINCT {_CODE} AS c FROM documents), {entropies('pwe', 'pw')},
    jpairs AS (SELECT doc_id AS id, 'password' AS key, {_CODE} AS value FROM ex WHERE name LIKE '%.json'
               UNION ALL SELECT doc_id, 'notes', text FROM ex WHERE name LIKE '%.json' AND text <> ''),
    {candidates('fc', 'src', DEFAULT, 'id', pairs='jpairs')},
    kn AS (SELECT id, count(*) AS known FROM fc WHERE c IN (SELECT c FROM pw) GROUP BY id),
    sc AS (SELECT ex.*, lower(content) AS lc, coalesce(g.hits, 0) AS gh, coalesce(n.hits, 0) AS nh,
                  coalesce(known, 0) AS known, pwe.e >= 4.0 AS strong
           FROM ex JOIN src s ON s.id = ex.doc_id LEFT JOIN ghit g ON g.id = ex.doc_id LEFT JOIN nhit n ON n.id = ex.doc_id
           LEFT JOIN kn ON kn.id = ex.doc_id JOIN pwe ON pwe.c = {_CODE}),
    fm AS (SELECT *, CASE
            WHEN name LIKE '%.json' THEN 'bitwarden_json'
            WHEN name LIKE '%.csv' AND contains(lc, 'password') AND contains(lc, 'login') AND (gh > 0 OR contains(lc, 'bitwarden'))
                 THEN 'bitwarden_csv'
            WHEN name LIKE '%.csv' AND (contains(lc, 'dashlane') OR (contains(lc, '"username"') AND contains(lc, '"password"')))
                 AND (gh > 0 OR contains(lc, 'dashlane')) THEN 'dashlane'
            WHEN name LIKE '%.1pif' AND gh > 0 THEN 'onepassword_1pif'
            WHEN gh >= 3 THEN 'generic_high_entropy'
            WHEN {" OR ".join(f"contains(name, {lit(m)})" for m in SUSPICIOUS_NAMES)} THEN CASE
                 WHEN name LIKE '%.csv' THEN 'bitwarden_csv' WHEN name LIKE '%.1pif' THEN 'onepassword_1pif'
                 ELSE 'suspicious_filename' END END AS format,
            CASE WHEN name LIKE '%.json' THEN nh + strong::INTEGER ELSE gh END AS hits FROM sc),
    found AS (SELECT *, CASE WHEN hits = 0 AND known = 0 THEN 'low' WHEN known > 0 OR format NOT IN
              ('generic_high_entropy', 'suspicious_filename') THEN 'high' ELSE 'medium' END AS confidence
              FROM fm WHERE format IS NOT NULL)"""
ORACLES["residue_findings"] = with_(
    _RESIDUE,
    f"""SELECT surface_no, path, lang || '/' || name AS location, name AS basename, {FIRST_DAY} + doc_id AS last_mod_s,
               format, confidence, known::INTEGER AS known_matches, hits::INTEGER AS entropy_hits,
               strlen(content) AS size FROM found""",
)
# As the residue findings, without the files that the rules of their surface leave out.
ORACLES["residue_with_rules"] = with_(
    f"""{_RESIDUE}, ruled AS (SELECT doc_id FROM (SELECT *, {choose(FOLDERS, 'doc_id')} AS folder FROM files) WHERE NOT {_IGNORED})""",
    f"""SELECT surface_no, path, lang || '/' || name AS location, name AS basename, {FIRST_DAY} + doc_id AS last_mod_s,
               format, confidence, known::INTEGER AS known_matches, hits::INTEGER AS entropy_hits,
               strlen(content) AS size FROM found SEMI JOIN ruled USING (doc_id)""",
)
ORACLES["residue_incremental"] = ORACLES["residue_with_rules"]
ORACLES["findings_sink"] = with_(
    _RESIDUE,
    f"""SELECT lang || '/' || name AS location, name AS basename, {FIRST_DAY} + doc_id AS last_mod, format, confidence,
               known::INTEGER AS known_matches, hits::INTEGER AS entropy_hits, strlen(content) AS size FROM found""",
)
ORACLES["residue_summary"] = with_(
    f"""{_RESIDUE}, dirs AS (SELECT DISTINCT lang, unnest(['', source, source || '/' || folder]) AS dir FROM (
            SELECT lang, source, {choose(FOLDERS, 'doc_id')} AS folder FROM paths WHERE lang IN ('en', 'de', 'es'))
            WHERE folder NOT IN {_SKIP}
          UNION SELECT lang, unnest(['', source]) FROM paths WHERE lang IN ('en', 'de', 'es'))""",
    """SELECT (SELECT count(*) FROM found) AS findings, (SELECT count(*) FROM ex) AS examined,
              (SELECT count(*) FROM dirs) AS scanned,
              (SELECT string_agg(location, ',' ORDER BY surface_no, path) FROM (
                  SELECT surface_no, path, lang || '/' || name AS location FROM found
                  ORDER BY surface_no, path LIMIT 3)) AS sample""",
)

ORACLES["residue_summary_stored"] = ORACLES["residue_summary"]

# --- history ----------------------------------------------------------------------------------

_LINES = f"""l0 AS (SELECT doc_id, unnest(range(len(a)))::INTEGER AS line_no, unnest(a) AS raw FROM (
        SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    lines AS (SELECT doc_id AS file_id, line_no, CASE WHEN line_no % 2 = 1 THEN ': ' || ({FIRST_DAY} + line_no) || ':0;'
              ELSE '' END AS prefix, raw AS cmd FROM l0)"""


def _scrubbed(lines: str) -> str:
    """CTEs giving ``scr(file_id, line_no, prefix, cmd, vs)`` with the known values of each line."""
    return f"""{DOC_C}, {lines},
    lsrc AS (SELECT file_id, line_no, CASE WHEN cmd = '' THEN prefix ELSE cmd END AS text FROM lines),
    {candidates('lc', 'lsrc', LOW, 'file_id, line_no')},
    lv AS (SELECT file_id, line_no, list(c ORDER BY c) AS vs FROM lc WHERE c IN (SELECT c FROM doc_c)
           GROUP BY file_id, line_no),
    scr AS (SELECT l.*, vs FROM lines l LEFT JOIN lv USING (file_id, line_no))"""


_REDACTED = f"""SELECT file_id, line_no, sha256(CASE WHEN vs IS NULL THEN prefix || cmd ELSE prefix || {replaced('cmd', 'vs')} END)
    AS final, CASE WHEN vs IS NULL THEN 'kept' ELSE 'redacted' END AS action, coalesce(len(vs), 0)::INTEGER AS secrets FROM scr"""
ORACLES["scrub_redact"] = with_(_scrubbed(_LINES), _REDACTED)
ORACLES["scrub_conversations"] = with_(
    _scrubbed("""lines AS (SELECT conv_id AS file_id, turn::INTEGER AS line_no, ': ' || turn || ':0;' AS prefix, text AS cmd
                 FROM conversations)"""),
    _REDACTED,
)
ORACLES["scrub_delete"] = with_(
    _scrubbed(_LINES),
    "SELECT file_id, line_no, sha256(prefix || cmd) AS final, 'kept' AS action, 0 AS secrets FROM scr WHERE vs IS NULL",
)
ORACLES["scrub_totals"] = with_(
    f"""{_scrubbed(_LINES)}, per AS (SELECT file_id, count(vs) AS redacted, coalesce(sum(len(vs)), 0)::BIGINT AS secrets
        FROM scr GROUP BY file_id)""",
    """SELECT file_id, 0::BIGINT AS deleted, redacted, secrets, (redacted > 0)::BIGINT AS changed_files FROM per
       UNION ALL SELECT NULL, 0, sum(redacted)::BIGINT, sum(secrets)::BIGINT, count(*) FILTER (redacted > 0) FROM per""",
)


def _receipt(version: str, n: str, tail: str, fp: str) -> str:
    end = f" || ':regfp={fp}'" if fp else ""
    return f"chr(10) || '# {TAG}:{version}:lines=' || {n} || ':tail=' || {tail}{end}"


_MARKER = "chr(10) || ': 1704067200:0;tool scrub-history --full'"
_MORE = """chr(10) || 'export K="' || sha256(source) || '"'"""
_KINDS = ", ".join(
    (
        "''",
        _receipt("v2", "n", "tail", REGFP),
        _receipt("v2", "n", "tail", "fedcba9876543210"),
        _receipt("v2", "n", "'00000000000000aa'", REGFP),
        _receipt("v1", "n", "tail", ""),
        f"{_MARKER} || {_receipt('v2', 'n', 'tail', REGFP)} || {_MORE}",
        f"{_MARKER} || {_receipt('v2', chr(39) + '100000' + chr(39), 'tail', REGFP)} || {_MORE}",
        f"{_MARKER} || chr(10) || 'ls' || {_MORE}",
    )
)


def tail_hash(a: str) -> str:
    return f"left(sha256(array_to_string({a}[-64:], chr(10))), 16)"


_RX = rf"^#\s*{TAG}:v(\d+):lines=(\d+):tail=([0-9a-f]+)(?::regfp=([0-9a-f]+))?"
HIST = f"""hf AS (SELECT doc_id, source, text || list_extract([{_KINDS}], (doc_id % 8 + 1)::INTEGER) AS content FROM (
        SELECT doc_id, source, text, len(string_split(text, chr(10))) AS n,
               {tail_hash("string_split(text, chr(10))")} AS tail FROM documents)),
    ha AS (SELECT doc_id AS file_id, content, string_split(content, chr(10)) AS a FROM hf),
    hb AS (SELECT *, list_filter(a, lambda x: NOT starts_with({trim('x')}, '# {TAG}:')) AS b FROM ha),
    hl AS (SELECT file_id, unnest(range(len(a)))::INTEGER AS line_no, unnest(a) AS line FROM ha),
    hr AS (SELECT file_id, line_no, regexp_extract({trim('line')}, '{_RX}', 1)::BIGINT AS version,
                  regexp_extract({trim('line')}, '{_RX}', 2)::BIGINT AS line_count,
                  regexp_extract({trim('line')}, '{_RX}', 3) AS tail_hash,
                  regexp_extract({trim('line')}, '{_RX}', 4) AS regfp
           FROM hl WHERE regexp_matches({trim('line')}, '{_RX}')),
    mk AS (SELECT file_id, max(line_no) AS m FROM hl
           WHERE contains(regexp_replace(line, '^:\\s*\\d+:\\d+;', ''), 'scrub-history') GROUP BY file_id),
    hd AS (SELECT hb.*, len(b) AS bn, {tail_hash('b')} AS bt, coalesce(m, -1) AS m FROM hb LEFT JOIN mk USING (file_id)),
    lr AS (SELECT file_id, arg_max(line_count, line_no) AS lr_n, arg_max(tail_hash, line_no) AS lr_t,
                  arg_max(regfp, line_no) AS lr_fp FROM hr GROUP BY file_id),
    nr AS (SELECT hr.file_id, arg_min(line_count, line_no) AS nr_n, arg_min(tail_hash, line_no) AS nr_t
           FROM hr JOIN mk ON hr.file_id = mk.file_id AND line_no BETWEEN m + 1 AND m + 3 GROUP BY hr.file_id),
    pl AS (SELECT hd.*, lr_n IS NOT NULL AS had, coalesce(lr_fp = '{REGFP}', false) AS fp_match,
                  lr_n IS NULL OR lr_fp <> '{REGFP}' OR bn < lr_n - 5 OR bt <> lr_t AS work,
                  nr_n IS NOT NULL AS near,
                  CASE WHEN m < 0 OR (nr_n IS NOT NULL AND (bn < nr_n - 5 OR bt <> nr_t)) THEN 0 ELSE m + 1 END AS start
           FROM hd LEFT JOIN lr USING (file_id) LEFT JOIN nr USING (file_id))"""
ORACLES["history_fingerprint"] = with_(
    HIST,
    f"""SELECT file_id, len(a)::BIGINT AS line_count, {tail_hash('a')} AS tail_hash, bn::BIGINT AS bare_count,
               bt AS bare_tail FROM hd""",
)
ORACLES["history_receipts"] = with_(HIST, "SELECT file_id, line_no, version, line_count, tail_hash, regfp FROM hr")
ORACLES["should_reprocess"] = with_(HIST, "SELECT file_id, had AS had_receipt, work FROM pl")
ORACLES["incremental_range"] = with_(
    HIST, "SELECT file_id, m::INTEGER AS marker_at, near, start::INTEGER AS start FROM pl"
)
_HV = f"""{DOC_C}, {HIST},
    secrets AS (SELECT c FROM doc_c UNION SELECT sha256(source) FROM documents),
    hs AS (SELECT hl.file_id, line_no, regexp_extract(line, '^:\\s*\\d+:\\d+;') AS prefix,
                  regexp_replace(line, '^:\\s*\\d+:\\d+;', '') AS text, line FROM hl JOIN pl USING (file_id)
           WHERE work AND line_no >= start),
    {candidates('hc', 'hs', LOW, 'file_id, line_no')},
    hv AS (SELECT file_id, line_no, list(c ORDER BY c) AS vs FROM hc WHERE c IN (SELECT c FROM secrets) GROUP BY ALL),
    ho AS (SELECT hl.file_id, hl.line_no, vs, CASE WHEN vs IS NULL THEN hl.line ELSE hs.prefix || {replaced('hs.text', 'vs')} END AS out
           FROM hl LEFT JOIN hs USING (file_id, line_no) LEFT JOIN hv USING (file_id, line_no)),
    hk AS (SELECT file_id, list(out ORDER BY line_no) AS k, count(vs) AS redacted, coalesce(sum(len(vs)), 0) AS n,
                  least(count(*) FILTER (vs IS NOT NULL AND contains(out, '[REDACTED]')), 3) AS ex FROM ho GROUP BY file_id)"""
ORACLES["scrub_files"] = with_(
    _HV,
    f"""SELECT file_id, sha256(CASE WHEN work THEN array_to_string(k, chr(10)) || chr(10) || '# {TAG}:v2:lines=' || len(k)
               || ':tail=' || {tail_hash('k')} || ':regfp={REGFP}' ELSE content END) AS content_hash,
               len(a)::INTEGER AS original_lines, (CASE WHEN work THEN len(a) - start ELSE 0 END)::INTEGER AS processed_lines,
               0 AS deleted, redacted::INTEGER AS redacted, n::INTEGER AS secrets, NOT work AS skipped, fp_match AS regfp_match,
               ex::INTEGER AS examples FROM pl JOIN hk USING (file_id)""",
)

_SCRUBBED_HASH = f"""sha256(CASE WHEN work THEN array_to_string(k, chr(10)) || chr(10) || '# {TAG}:v2:lines=' || len(k)
               || ':tail=' || {tail_hash('k')} || ':regfp={REGFP}' ELSE content END)"""
ORACLES["scrubbed_sink"] = with_(_HV, f"SELECT file_id, {_SCRUBBED_HASH} AS content_hash FROM pl JOIN hk USING (file_id)")
ORACLES["history_incremental"] = with_(
    _HV,
    f"""SELECT file_id, {_SCRUBBED_HASH} AS content_hash, len(a)::INTEGER AS original_lines,
               (CASE WHEN work THEN len(a) - start ELSE 0 END)::INTEGER AS processed_lines, redacted::INTEGER AS redacted, n::INTEGER AS secrets,
               NOT work AS skipped FROM pl JOIN hk USING (file_id)""",
)
ORACLES["scrub_preview"] = with_(
    _HV,
    """SELECT file_id, 0 AS would_delete, redacted::INTEGER AS would_redact, n::INTEGER AS secrets_found, ex::INTEGER AS examples
       FROM pl JOIN hk USING (file_id) WHERE redacted > 0""",
)
ORACLES["scrub_report"] = with_(
    _HV,
    """SELECT count(*) AS targets, count(*) FILTER (redacted > 0) AS changed_files, 0 AS deleted, sum(redacted)::BIGINT AS redacted,
              sum(n)::BIGINT AS secrets, count(*) FILTER (NOT work) AS skipped FROM pl JOIN hk USING (file_id)""",
)

# --- monitor ----------------------------------------------------------------------------------

_HOUR = 3_600_000_000
_CLOCK = "(SELECT max(ts) FROM sn)"
_SNAPSHOTS = f"""{DOC_C},
    kn AS (SELECT id, count(*)::INTEGER AS secrets FROM doc_c GROUP BY id),
    sn AS (SELECT user_id::VARCHAR AS surface_id, epoch_us(ts) AS ts, sha256(coalesce(text, '')) AS content_hash,
                  coalesce(secrets, 0) AS secrets FROM events e LEFT JOIN documents d ON d.doc_id = floor(value)::BIGINT
           LEFT JOIN kn ON kn.id = d.doc_id),
    pv AS (SELECT *, lag(content_hash) OVER (PARTITION BY surface_id ORDER BY ts, content_hash) AS prev FROM sn),
    ep AS (SELECT *, lead(ts) OVER (PARTITION BY surface_id ORDER BY ts, content_hash) AS until FROM pv
           WHERE content_hash IS DISTINCT FROM prev)"""


def _acts(timed: str) -> str:
    return f"""{_SNAPSHOTS},
    acts AS (SELECT surface_id, ts, 'alert' AS action, secrets, content_hash, ts AS changed_at FROM ep WHERE secrets > 0
             UNION ALL SELECT surface_id, ts + 3 * {_HOUR}, '{timed}', secrets, content_hash, ts FROM ep
             WHERE secrets > 0 AND (until IS NULL OR until > ts + 3 * {_HOUR}) AND ts + 3 * {_HOUR} <= {_CLOCK})"""


_MONITOR = _acts("redact")
for _name, _ctes in (("monitor_batch", _MONITOR), ("monitor_stream", _MONITOR), ("monitor_clear", _acts("clear"))):
    ORACLES[_name] = with_(_ctes, "SELECT surface_id, ts, action, secrets, content_hash, changed_at FROM acts")
_STATUS = (
    """, ev AS (SELECT surface_id, ts, 0 AS rank, secrets, 'snapshot' AS action FROM sn
            UNION ALL SELECT surface_id, ts, 1, 0, action FROM acts WHERE action <> 'alert'),
        la AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY surface_id ORDER BY ts DESC, rank DESC) = 1),
        al AS (SELECT surface_id, max(ts) AS last_change FROM ep WHERE secrets > 0 GROUP BY surface_id)""",
    """SELECT surface_id, secrets, last_change, action = 'redact' AS redacted, action = 'clear' AS cleared
       FROM la LEFT JOIN al USING (surface_id)""",
)
_NOTHING = f"{_SNAPSHOTS}, acts AS (SELECT surface_id, ts, 'redact' AS action FROM ep WHERE false)"
for _name, _ctes in (("monitor_status", _MONITOR), ("monitor_clear_status", _acts("clear")), ("monitor_quiet_status", _NOTHING)):
    ORACLES[_name] = with_(_ctes + _STATUS[0], _STATUS[1])
ORACLES["monitor_state"] = with_(
    f"""{_MONITOR}, le AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY surface_id ORDER BY ts DESC, content_hash DESC) = 1),
        al AS (SELECT surface_id, max(ts) AS last_change FROM ep WHERE secrets > 0 GROUP BY surface_id),
        dn AS (SELECT surface_id, changed_at, content_hash, action FROM acts WHERE action <> 'alert')""",
    """SELECT le.surface_id, CASE WHEN dn.action IS NULL THEN le.secrets ELSE 0 END AS secrets, last_change,
              coalesce(dn.action = 'redact', false) AS redacted, coalesce(dn.action = 'clear', false) AS cleared
       FROM le LEFT JOIN al USING (surface_id)
       LEFT JOIN dn ON dn.surface_id = le.surface_id AND dn.changed_at = le.ts AND dn.content_hash = le.content_hash""",
)
ORACLES["overall_status"] = with_(
    f"""{_MONITOR}, {PATHS},
        hp AS (SELECT sha256(c) AS hash, count(DISTINCT lang || source) AS n FROM doc_c JOIN documents ON doc_id = id GROUP BY 1)""",
    f"""SELECT 'registry' AS section, '{{"tracked_hashes":' || count(*) || ',"duplicate_hashes":' || count(*) FILTER (n > 1)
               || ',"scan_state":"completed"}}' AS body FROM hp
        UNION ALL SELECT 'discovery', '{{"hashes":' || count(DISTINCT hash) || ',"projects":' || count(DISTINCT project_id) || '}}'
            FROM ({ORACLES["discovery_registry"]})
        UNION ALL SELECT 'residue', '{{"findings":' || findings || ',"examined":' || examined || ',"scanned":' || scanned
            || ',"sample":"' || sample || '"}}' FROM ({ORACLES["residue_summary"]})
        UNION ALL SELECT 'monitor', '{{"alerts":' || count(*) || '}}' FROM acts WHERE action = 'alert'""",
)
