"""Go files read by SQL alone: tokens by one regular expression, everything else by windows over their rows.

The other account of what the front end finds, for holding the two against each
other; it knows no syntax tree, so lines and nesting come from brackets and line
ends. Its readers expect a view g(module, rel, dir, body) of the files to read.
"""

from __future__ import annotations

_TOKEN = (
    r"(?s)//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\[^\n][^''\n]*)''|[\p{L}_][\p{L}\p{Nd}_]*"
    r"|(?:0[xX][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9][0-9_]*)i?"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]|\n"
)
_FILE = "PARTITION BY module, rel"
_UNIT = "PARTITION BY module, rel, piece"

#: tok: every token and line end, with its line, its bracket depth, and piece, the number of the declaration it lies in.
TOKENS = f"""
ta AS (SELECT module, rel, dir, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT module, rel, dir, regexp_extract_all(body, '{_TOKEN}') AS toks FROM g)),
tb AS (SELECT *, starts_with(tok, '//') OR starts_with(tok, '/*') AS remark, tok = chr(10) AS nl, len(tok) - len(replace(tok, chr(10), '')) AS breaks,
         CASE WHEN tok IN ('(', '[', '{{') THEN 1 ELSE 0 END AS opens, CASE WHEN tok IN (')', ']', '}}') THEN 1 ELSE 0 END AS closes FROM ta),
tc AS (SELECT *, CAST(1 + coalesce(sum(breaks) OVER ({_FILE} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line, sum(opens - closes) OVER ({_FILE} ORDER BY i) - opens AS depth FROM tb),
tok AS (SELECT *, coalesce(sum(CASE WHEN nl AND depth = 0 THEN 1 ELSE 0 END) OVER ({_FILE} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM tc)
"""

#: unit_tok: the tokens of every function with their place k in it; unit: one row a function.
UNITS = f"""
fa AS (SELECT *, row_number() OVER ({_UNIT} ORDER BY i) AS k, first(tok) OVER ({_UNIT} ORDER BY i) = 'func' AS is_func FROM tok WHERE NOT remark AND NOT nl),
fb AS (SELECT *, lag(tok) OVER w AS before, lead(tok) OVER w AS after, lead(line) OVER w AS next_line, max(k) OVER ({_UNIT}) AS size, max(CASE WHEN k = 2 AND tok = '(' THEN 1 ELSE 0 END) OVER ({_UNIT}) AS received FROM fa WHERE is_func WINDOW w AS ({_UNIT} ORDER BY i)),
fc AS (SELECT *, CASE WHEN received = 1 THEN min(CASE WHEN tok = ')' AND depth = 0 THEN k END) OVER ({_UNIT}) + 1 ELSE 2 END AS name_k FROM fb),
fd AS (SELECT *, min(CASE WHEN k > name_k AND tok = '(' AND depth = 0 THEN k END) OVER ({_UNIT}) AS par_k, max(CASE WHEN k = name_k THEN tok END) OVER ({_UNIT}) AS name FROM fc),
fe0 AS (SELECT *, min(CASE WHEN k > par_k AND tok = ')' AND depth = 0 THEN k END) OVER ({_UNIT}) AS par_end FROM fd),
fe AS (SELECT *, max(CASE WHEN k > par_end AND tok = '{{' AND depth = 0 AND before NOT IN ('struct', 'interface') THEN 1 ELSE 0 END) OVER ({_UNIT}) = 1 AS has_body FROM fe0),
-- the bracket a token lies in: openings count once more, as marks of the level below them
fm AS (SELECT *, i AS mark, depth + 1 AS level FROM fe WHERE opens = 1 UNION ALL SELECT *, NULL, depth FROM fe),
ff AS (SELECT * EXCLUDE (mark, level), max(mark) OVER ({_UNIT}, level ORDER BY i, mark NULLS LAST) AS enc, mark IS NOT NULL AS is_mark FROM fm),
unit_tok AS (SELECT * EXCLUDE (is_mark), line + breaks < next_line AND (tok IN (')', ']', '}}', '++', '--', 'break', 'continue', 'fallthrough', 'return')
         OR regexp_matches(tok, '^[\\p{{L}}_0-9"`''.]') AND tok NOT IN ('.', '...', 'case', 'chan', 'const', 'default', 'defer', 'else', 'for', 'func', 'go', 'goto', 'if', 'import', 'interface', 'map', 'package', 'range', 'select', 'struct', 'switch', 'type', 'var')) AS ends
       FROM ff WHERE NOT is_mark),
-- what opens a brace: the last of these words in its bracket since the line of statements began
fg AS (SELECT *, coalesce(sum(CASE WHEN ends OR tok IN ('{{', '}}') THEN 1 ELSE 0 END) OVER ({_UNIT}, enc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM unit_tok),
fh AS (SELECT *, last_value(CASE WHEN tok IN ('if', 'for', 'switch', 'select', 'func', 'else', 'struct', 'interface') THEN tok END IGNORE NULLS) OVER ({_UNIT}, enc, st ORDER BY i) AS word FROM fg),
fi AS (SELECT *, CASE WHEN tok = '{{' AND depth > 0 THEN coalesce(word, '') WHEN tok = '}}' AND depth > 0 THEN lag(CASE WHEN tok = '{{' THEN coalesce(word, '') END) OVER ({_UNIT}, depth, tok IN ('{{', '}}') ORDER BY i) END AS block FROM fh),
fj AS (SELECT *, CASE WHEN block IN ('if', 'for', 'switch', 'select', 'func', 'else') THEN opens - closes ELSE 0 END AS deeper, CASE WHEN block = 'for' THEN opens - closes ELSE 0 END AS looped, CASE WHEN block = 'func' THEN opens - closes ELSE 0 END AS enclosed FROM fi),
fk AS (SELECT *, sum(deeper) OVER ({_UNIT} ORDER BY i) - CASE WHEN opens = 1 THEN deeper ELSE 0 END AS nest FROM fj),
fl AS (SELECT *, coalesce(sum(CASE WHEN ends OR tok IN ('{{', '}}', ';', ',', ':', '=', ':=', 'return', 'if', 'for', 'case', 'switch') THEN 1 ELSE 0 END) OVER ({_UNIT}, enc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM fk),
fo AS (SELECT *, tok IN ('&&', '||') AND tok IS DISTINCT FROM lag(tok) OVER ({_UNIT}, enc, chain, tok IN ('&&', '||') ORDER BY i) AS run FROM fl),
unit AS (SELECT module, rel, piece, min(line) AS line, max(name) AS name, CAST(count(*) AS INT) AS tokens, CAST(count(DISTINCT line) AS INT) AS loc, bool_or(has_body) AS has_body, max(i) AS last_i, min(i) AS first_i,
         CAST(CASE WHEN count(*) FILTER (WHERE k > par_k AND k < par_end) = 0 THEN 0 ELSE 1 + count(*) FILTER (WHERE k > par_k AND k < par_end AND tok = ',' AND depth = 1 AND after <> ')') END AS INT) AS params,
         CAST(CASE WHEN NOT bool_or(has_body) THEN 0 ELSE 1 + count(*) FILTER (WHERE tok IN ('if', 'for', 'case', '&&', '||')) END AS INT) AS mccabe,
         CAST(CASE WHEN NOT bool_or(has_body) THEN 0 ELSE coalesce(sum(CASE
           WHEN tok = 'if' AND before = 'else' THEN 0 WHEN tok IN ('if', 'for', 'switch', 'select') THEN 1 + nest WHEN tok = 'else' OR run THEN 1
           WHEN tok IN ('break', 'continue', 'goto') AND NOT ends THEN 1 WHEN tok = name AND k <> name_k AND after = '(' THEN 1 ELSE 0 END), 0) END AS INT) AS complexity,
         CASE WHEN max(received) = 1 THEN '(' || regexp_replace(replace(string_agg(CASE WHEN k > 2 AND k < name_k - 1 THEN tok ELSE '' END, ' ' ORDER BY i), ',', ', '), '^ *(?:[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]* +([*\\p{{L}}_]))?', '\\1') || ').' ELSE '' END AS receiver
       FROM fo GROUP BY module, rel, piece),
units AS (SELECT *, regexp_replace(regexp_replace(receiver, ' +', '', 'g'), ',', ', ', 'g') || name AS element FROM unit)
"""

UNIT_ROWS = "SELECT module, rel, element, line, tokens, params, complexity, loc, mccabe, has_body FROM units"

#: decl: one row a declaration (functions aside), with its first name; spec: one row a name that starts a spec of it; own: comments with nothing before them on their line.
DECLS = f"""
da AS (SELECT *, row_number() OVER ({_UNIT} ORDER BY i) AS k, first(tok) OVER ({_UNIT} ORDER BY i) AS word, lag(line) OVER ({_UNIT} ORDER BY i) AS prev_line, lag(tok) OVER ({_UNIT} ORDER BY i) AS before FROM tok WHERE NOT remark AND NOT nl),
db AS (SELECT *, max(CASE WHEN k = 2 AND tok = '(' THEN 1 ELSE 0 END) OVER ({_UNIT}) AS grouped, min(line) OVER ({_UNIT}) AS decl_line FROM da WHERE word IN ('const', 'var', 'type')),
spec AS (SELECT module, rel, piece, word, tok AS name, line, decl_line, grouped FROM db WHERE grouped = 0 AND k = 2 OR grouped = 1 AND depth = 1 AND closes = 0 AND (before = '(' AND k = 3 OR before = ';' OR line > prev_line)),
decl AS (SELECT module, rel, piece, min(i) AS first_i, max(i) AS last_i, min(tok) FILTER (WHERE k = 2 + grouped) AS element FROM db GROUP BY module, rel, piece),
own AS (SELECT module, rel, line + breaks AS last_line FROM (SELECT *, lag(nl) OVER ({_FILE} ORDER BY i) AS starts FROM tok) WHERE remark AND coalesce(starts, true)),
span AS (SELECT module, rel, first_i, last_i, element FROM units UNION ALL SELECT module, rel, first_i, last_i, element FROM decl)
"""

_FINDING = "'finding' AS severity, CAST(0 AS BIGINT) AS value"
_BASE = "regexp_extract(rel, '[^/]*$')"


def size_findings(bands: dict[str, tuple[int, int]]) -> str:
    parts = []
    for rule, column, says in (("FUNCTION_SIZE_RISK", "tokens", "function size in tokens"), ("PARAMETER_RISK", "params", "parameters"), ("FUNCTION_COMPLEXITY_RISK", "complexity", "cognitive complexity")):
        high, very = bands[rule]
        parts.append(
            f"SELECT module, '{rule}' AS rule, element, '{says}: ' || {column} || CASE WHEN {column} > {very} THEN ' (very high risk, [> {very}])' ELSE ' (high risk, [{high + 1} - {very}])' END AS description, rel AS file, line, "
            f"CASE WHEN {column} > {very} THEN 'very high risk' ELSE 'high risk' END AS severity, CAST({column} AS BIGINT) AS value FROM units WHERE {column} > {high}"
        )
    return " UNION ALL ".join(parts)


def comment_findings(notice: str, unfinished: str, suppression: str) -> str:
    text = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '^//', ''), '^/\\*', ''), '^\\s+|\\s+$', '', 'g'), '\\*/$', ''), '^\\s+|\\s+$', '', 'g')"
    clipped = f"CASE WHEN strlen({text}) > 90 THEN {text}[1:87] || '...' ELSE {text} END"  # the texts it is used on are ASCII
    rules = [("COPYRIGHT_OR_LICENSE_NOTICE", notice, ""), ("UNFINISHED_WORK", unfinished, ""), ("SUPPRESSED_WARNING", suppression, "lint suppression: ")]
    return " UNION ALL ".join(
        f"SELECT r.module, '{rule}' AS rule, coalesce(s.element, regexp_extract(r.rel, '[^/]*$')) AS element, '{says}' || {clipped} AS description, r.rel AS file, r.line, {_FINDING} "
        f"FROM (SELECT * FROM tok WHERE remark AND regexp_matches(tok, '{pattern}')) r LEFT JOIN span s ON r.module = s.module AND r.rel = s.rel AND r.i BETWEEN s.first_i AND s.last_i"
        for rule, pattern, says in rules
    )


#: Loops within loops; a function literal begins anew.
NESTED_LOOPS = f"""
la AS (SELECT *, sum(looped) OVER ({_UNIT} ORDER BY i) - CASE WHEN opens = 1 THEN looped ELSE 0 END AS loops, sum(enclosed) OVER ({_UNIT} ORDER BY i) - CASE WHEN opens = 1 THEN enclosed ELSE 0 END AS literals FROM fo),
lb AS (SELECT *, CAST(NULL AS BIGINT) AS mark, literals AS level FROM la UNION ALL SELECT *, i * 1000 + loops, literals + 1 FROM la WHERE enclosed = 1),
lc AS (SELECT *, loops - coalesce(max(mark) OVER ({_UNIT}, level ORDER BY i, mark NULLS LAST) % 1000, 0) AS inside FROM lb),
nested AS (SELECT lc.module, 'NESTED_LOOP' AS rule, element, 'loop nested ' || CAST(inside + 1 AS INT) || ' deep; the work inside runs the product of both counts' AS description, lc.rel AS file, lc.line, {_FINDING}
           FROM lc JOIN units USING (module, rel, piece) WHERE lc.mark IS NULL AND tok = 'for' AND inside >= 1)
"""

#: Branches that do nothing, and switches that leave values out. An arm with nothing but a remark speaks for itself.
BRANCHES = f"""
ba AS (SELECT *, last_value(CASE WHEN tok IN ('if', 'for', 'switch', 'select', 'func', 'else', 'struct', 'interface') THEN line END IGNORE NULLS) OVER ({_UNIT}, enc, st ORDER BY i) AS word_line,
         last_value(CASE WHEN tok = 'switch' THEN k END IGNORE NULLS) OVER ({_UNIT}, enc, st ORDER BY i) AS switch_k, lead(tok, 2) OVER ({_UNIT} ORDER BY i) AS after2, lag(tok, 2) OVER ({_UNIT} ORDER BY i) AS before2 FROM fo),
empty_branch AS (SELECT ba.module, 'EMPTY_BRANCH' AS rule, element, 'if statement with an empty body and no else; the condition is tested and then ignored' AS description, ba.rel AS file, word_line AS line, {_FINDING}
          FROM ba JOIN units USING (module, rel, piece) WHERE tok = '{{' AND block = 'if' AND after = '}}' AND after2 IS DISTINCT FROM 'else'),
bs AS (SELECT module, rel, piece, i, word_line, before = ')' AND before2 = 'type' AS by_type, before = 'switch' OR before = ';' AS bare,
         before = ')' AND before2 <> 'type' AND EXISTS (SELECT 1 FROM fo o WHERE o.module = ba.module AND o.rel = ba.rel AND o.piece = ba.piece AND o.k > ba.switch_k AND o.k < ba.k AND o.enc IS NOT DISTINCT FROM ba.enc AND o.tok = '(' AND regexp_matches(o.before, '^[\\p{{L}}_\\]]') AND o.before <> 'switch') AS called
       FROM ba WHERE tok = '{{' AND block = 'switch'),
bare_switch AS (SELECT bs.module, 'SWITCH_WITHOUT_DEFAULT' AS rule, element, CASE WHEN by_type THEN 'type switch' ELSE 'switch' END || ' has no default clause; an unhandled value passes through silently' AS description, bs.rel AS file, word_line AS line, {_FINDING}
          FROM bs JOIN units USING (module, rel, piece) WHERE NOT bare AND NOT called
          AND NOT EXISTS (SELECT 1 FROM fo WHERE fo.module = bs.module AND fo.rel = bs.rel AND fo.piece = bs.piece AND fo.enc = bs.i AND fo.tok = 'default')
          AND NOT EXISTS (SELECT 1 FROM (SELECT *, lead(tok) OVER ({_FILE} ORDER BY i) AS follows FROM tok WHERE NOT nl) c JOIN fo ON fo.module = c.module AND fo.rel = c.rel AND fo.i = c.i
                          WHERE fo.module = bs.module AND fo.rel = bs.rel AND fo.piece = bs.piece AND fo.enc = bs.i AND c.tok = ':' AND (c.follows LIKE '//%' OR c.follows LIKE '/*%') AND fo.after IN ('case', 'default', '}}')))
"""

DEBUG = f"""
ia AS (SELECT DISTINCT module, rel FROM (SELECT *, first(tok) OVER ({_UNIT} ORDER BY i) AS word, lag(tok) OVER ({_UNIT} ORDER BY i) AS before FROM tok WHERE NOT remark AND NOT nl) WHERE word = 'import' AND tok = '"log"' AND NOT regexp_matches(before, '^[\\p{{L}}_.]') OR word = 'import' AND tok = '"log"' AND before IN ('import', 'log')),
ca AS (SELECT *, lag(tok, 2) OVER ({_UNIT} ORDER BY i) AS before2, lag(tok, 3) OVER ({_UNIT} ORDER BY i) AS before3 FROM fo),
cb AS (SELECT *, CASE WHEN before = '.' AND regexp_matches(before2, '^[\\p{{L}}_]') AND before3 IS DISTINCT FROM '.' THEN before2 END AS pkg FROM ca WHERE k > name_k AND after = '(' AND regexp_matches(tok, '^[\\p{{L}}_]')),
debug AS (SELECT module, rel, piece, line, CASE WHEN before IS DISTINCT FROM '.' AND tok IN ('print', 'println') THEN 'builtin ' || tok || '() writes to stderr and is not a logger' WHEN pkg = 'fmt' AND starts_with(tok, 'Print') THEN 'fmt.' || tok || '() writes to stdout instead of the logger'
           WHEN pkg = 'log' AND (module, rel) IN (SELECT module, rel FROM ia) THEN 'standard log.' || tok || '() bypasses the structured slog logger' END AS says FROM cb)
"""
DEBUG_ROWS = f"SELECT d.module, 'DEBUG_STATEMENT' AS rule, element, says AS description, d.rel AS file, d.line, {_FINDING} FROM debug d JOIN units USING (module, rel, piece) WHERE says IS NOT NULL AND NOT regexp_matches(d.rel, '^cmd(/|$)')"

DOC_ROWS = f"""
SELECT module, 'MISSING_DOC_COMMENT' AS rule, element, 'exported ' || CASE WHEN receiver <> '' THEN 'method' ELSE 'function' END || ' has no doc comment' AS description, rel AS file, line, {_FINDING} FROM units u
WHERE regexp_matches(name, '^\\p{{Lu}}') AND (receiver = '' OR regexp_matches(receiver, '^\\( *\\*? *\\p{{Lu}}')) AND NOT EXISTS (SELECT 1 FROM own WHERE own.module = u.module AND own.rel = u.rel AND own.last_line = u.line - 1)
UNION ALL
SELECT module, 'MISSING_DOC_COMMENT', name, 'exported ' || word || ' ' || name || ' in ' || {_BASE} || ' has no doc comment', rel, line, {_FINDING} FROM spec s
WHERE regexp_matches(name, '^\\p{{Lu}}') AND NOT EXISTS (SELECT 1 FROM own WHERE own.module = s.module AND own.rel = s.rel AND (own.last_line = s.decl_line - 1 OR s.grouped = 1 AND own.last_line = s.line - 1))
"""

_PLAIN = "substr(tok, 2, len(tok) - 2)"
#: String literals as written between their quotes; imports and field tags aside.
LITERAL_ROWS = f"""
SELECT l.module, l.rel, s.element, l.line, CASE WHEN starts_with(tok, '`') THEN replace({_PLAIN}, chr(13), '') ELSE replace(replace(replace(replace({_PLAIN}, '\\n', chr(10)), '\\t', chr(9)), '\\"', '"'), '\\\\', '\\') END AS value
FROM (SELECT *, first(tok) OVER ({_UNIT} ORDER BY i) AS word FROM tok WHERE NOT remark AND NOT nl) l LEFT JOIN units s ON l.module = s.module AND l.rel = s.rel AND l.i BETWEEN s.first_i AND s.last_i
WHERE regexp_matches(tok, '^["`]') AND word <> 'import' AND NOT (starts_with(tok, '`') AND regexp_matches(tok, '^`[a-z]+:"[^`]*"`$'))
"""

_PATH = "CASE WHEN dir = '.' THEN module ELSE module || '/' || dir END"
#: dep: counted references of files to what they import and to their siblings, names that a function binds aside.
DEPENDENCIES = f"""
ra AS (SELECT *, first(tok) OVER ({_UNIT} ORDER BY i) AS word, row_number() OVER ({_UNIT} ORDER BY i) AS k, lag(tok) OVER w AS before, lag(line) OVER w AS before_line, lead(tok) OVER w AS after, lead(tok, 2) OVER w AS after2, lead(tok, 3) OVER w AS after3, regexp_matches(tok, '^[\\p{{L}}_]') AS named
       FROM tok WHERE NOT remark AND NOT nl WINDOW w AS ({_UNIT} ORDER BY i)),
rb AS (SELECT module, rel, CASE WHEN before IN ('import', '(', ';') OR line > before_line THEN regexp_extract(tok, '([^/"]*)"$', 1) ELSE before END AS local_name, trim(tok, '"') AS path FROM ra WHERE word = 'import' AND starts_with(tok, '"')),
rc AS (SELECT module, {_PATH} AS path, name, max(rel) AS target FROM (SELECT module, rel, dir, name FROM (SELECT DISTINCT module, rel, dir FROM tok) JOIN (SELECT module, rel, name FROM units WHERE receiver = '' UNION SELECT module, rel, name FROM spec) USING (module, rel)) GROUP BY ALL),
rd AS (SELECT DISTINCT module, rel, piece, tok AS name FROM ra WHERE word = 'func' AND named AND (after = ':=' OR after = ',' AND after3 = ':=' OR before = 'var' OR before IN ('(', ',') AND (regexp_matches(after, '^[\\p{{L}}_]') OR after IN ('*', '[', '...')))),
re AS (SELECT module, rel, dir, piece, CASE WHEN after = '.' AND regexp_matches(after2, '^[\\p{{L}}_]') THEN tok END AS qualifier, CASE WHEN after = '.' THEN after2 ELSE tok END AS name
       FROM ra WHERE named AND word IN ('func', 'type', 'const', 'var') AND before IS DISTINCT FROM '.' AND NOT (after = ':' AND before IN ('{{', ','))),
rf AS (SELECT re.*, coalesce(qualifier, re.name) AS head FROM re WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.module = re.module AND rd.rel = re.rel AND rd.piece = re.piece AND rd.name = coalesce(re.qualifier, re.name))),
rg AS (SELECT rf.*, rb.path FROM rf LEFT JOIN rb ON rf.module = rb.module AND rf.rel = rb.rel AND rf.qualifier = rb.local_name),
dep AS (SELECT rg.module, rg.rel, coalesce(rc.target, rg.path) AS target, rg.path AS coarse, false AS sibling FROM rg LEFT JOIN rc ON rg.module = rc.module AND rg.path = rc.path AND rg.name = rc.name WHERE rg.path IS NOT NULL
        UNION ALL SELECT rg.module, rg.rel, rc.target, rc.target, true FROM rg JOIN rc ON rg.module = rc.module AND CASE WHEN rg.dir = '.' THEN rg.module ELSE rg.module || '/' || rg.dir END = rc.path AND rg.head = rc.name WHERE rg.path IS NULL AND rc.target <> rg.rel)
"""
DEPENDENCY_ROWS = """
SELECT p.module, p.rel, p.line, CAST(count(d.target) AS BIGINT) AS volume, CAST(count(d.target) FILTER (WHERE sibling) AS BIGINT) AS volume_local, CAST(count(d.target) FILTER (WHERE NOT sibling) AS BIGINT) AS volume_cross,
       CAST(count(DISTINCT d.coarse) AS INT) AS span, coalesce(list_sort(list_distinct(list(d.coarse) FILTER (WHERE d.coarse IS NOT NULL))), []) AS targets
FROM (SELECT module, rel, min(line) AS line FROM tok WHERE tok = 'package' AND depth = 0 GROUP BY module, rel) p LEFT JOIN dep d ON p.module = d.module AND p.rel = d.rel GROUP BY p.module, p.rel, p.line
"""
FAN_IN_ROWS = """
SELECT module || '/' || target AS target, CAST(count(DISTINCT rel) AS BIGINT) AS in_modules, CAST(count(*) AS BIGINT) AS in_refs FROM dep
WHERE target <> rel AND (module, target) IN (SELECT DISTINCT module, rel FROM tok) GROUP BY 1
"""

#: Six lines of tokens that stood before, in the order of files and lines.
DUPLICATION_ROWS = """
ln AS (SELECT module, rel, line, string_agg(tok, ' ' ORDER BY i) AS l FROM tok WHERE NOT remark AND NOT nl GROUP BY module, rel, line),
li AS (SELECT *, row_number() OVER (PARTITION BY module, rel ORDER BY line) - 1 AS i FROM ln),
fr AS (SELECT module, rel, i, string_agg(l, chr(10)) OVER w AS t, count(*) OVER w AS n FROM li WINDOW w AS (PARTITION BY module, rel ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
oc AS (SELECT module, rel, i, row_number() OVER (PARTITION BY t ORDER BY module, rel, i) AS r FROM fr WHERE n = 6),
red AS (SELECT DISTINCT module, rel, i + unnest(range(6)) AS i FROM oc WHERE r > 1)
SELECT module, rel, l.loc, r.redundant_loc, redundant_loc / CAST(loc AS DOUBLE) * 100 AS pct FROM (SELECT module, rel, count(*) AS loc FROM li GROUP BY 1, 2) l JOIN (SELECT module, rel, count(*) AS redundant_loc FROM red GROUP BY 1, 2) r USING (module, rel)
"""


def tail_rows(properties: dict, margin: float) -> str:
    """Tail shares of the rows of a(language, ...), with the roll-up over all languages."""
    held = []
    for name, (column, _, tails) in properties.items():
        for threshold, inclusive, cap in tails:
            label = f"{'>=' if inclusive else '>'} {threshold}"
            held.append(f"SELECT language, '{name}' AS property, '{label}' AS tail, {cap}::DOUBLE AS cap_pct, count(*) FILTER (WHERE h) AS elements, coalesce(sum(loc) FILTER (WHERE h), 0) AS loc, sum(loc) AS total FROM (SELECT *, {column} {'>=' if inclusive else '>'} {threshold} AS h FROM b) GROUP BY language")
    pct = "CAST(loc AS DOUBLE) / CAST(total AS DOUBLE) * 100"
    return f""", b AS (SELECT * FROM a UNION ALL SELECT * REPLACE ('combined' AS language) FROM a), s AS ({' UNION ALL '.join(held)})
SELECT language, property, tail, cap_pct, elements, CAST(loc AS BIGINT) AS loc, CAST(total AS BIGINT) AS total, {pct} AS pct, {pct} <= cap_pct AS pass, abs({pct} - cap_pct) <= {margin}::DOUBLE AS at_cap, CASE WHEN {pct} <= cap_pct THEN 0 ELSE CAST(ceil(loc - cap_pct / 100 * total) AS BIGINT) END AS excess_loc FROM s"""
