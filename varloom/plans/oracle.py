"""DuckDB SQL that states the registered queries independently of the Spark plans."""

from __future__ import annotations

import re

from varloom.config import ALLOWED, COLOR_HINTS, EXCLUDED, KEYWORDS, PROPERTIES
from varloom.functions.color import NAMED
from varloom.functions.globs import glob_regex
from varloom.functions.values import COLOR_PROPERTIES, FONT_PROPERTIES, SPACING_PROPERTIES, UNITS
from varloom.operators.report import TITLE
from varloom.plans.corpus import CHANGED, CHANGES_SQL, COMPONENTS_SQL, CURSORS_SQL, DELETED, SHEETS_SQL, TOKENS_SQL, VALUES_SQL

RULE = r"([^{}]+)\{([^{}]*)\}"
DECLARATION = r"([a-zA-Z-]+)\s*:\s*([^;]+);?"
VAR = r"var\(\s*(--[\w-]+)\s*(?:,\s*([^)]+))?\s*\)"
DEFINITION = r"(--[\w-]+)\s*:\s*([^;{}]+);"
COMMENT = r"/\*[\s\S]*?\*/"


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def trim(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def clean(v: str) -> str:
    return trim(f"regexp_replace(regexp_replace({v}, '!important', '', 'gi'), ';$', '')")


_N = r"\s*(\d{1,3})\s*"
FORMS = {
    "rgb": rf"(?i)^rgb\({_N},{_N},{_N}\)$",
    "rgba": rf"(?i)^rgba\({_N},{_N},{_N},\s*([\d.]+)\s*\)$",
    "rgbm": r"(?i)^rgb\(\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})\s*(?:/\s*([\d.]+%?))?\s*\)$",
    "hsl": r"(?i)^hsl\(\s*(\d{1,3})\s*,\s*(\d{1,3})%\s*,\s*(\d{1,3})%\s*\)$",
    "hsla": r"(?i)^hsla\(\s*(\d{1,3})\s*,\s*(\d{1,3})%\s*,\s*(\d{1,3})%\s*,\s*([\d.]+)\s*\)$",
    "hslm": r"(?i)^hsl\(\s*(\d{1,3})\s+(\d{1,3})%\s+(\d{1,3})%\s*(?:/\s*([\d.]+%?))?\s*\)$",
}
HEX = "(?i)^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"


def is_color(v: str) -> str:
    c = f"lower({trim(v)})"
    return f"({c} IN {_in(NAMED)} OR regexp_matches({c}, '{HEX}')" + "".join(f" OR regexp_matches({c}, '{f}')" for f in FORMS.values()) + ")"


def hardcoded(v: str) -> str:
    t = trim(v)
    return rf"(NOT contains({v}, 'var(') AND (regexp_matches({t}, '(?i)^(rgb|hsl)a?\s*\(') OR regexp_matches({t}, '(?i)^-?\d+(\.\d+)?({UNITS})$') OR {is_color(v)}))"


def kind(v: str) -> str:
    t = trim(v)
    return rf"CASE WHEN {is_color(v)} OR regexp_matches({t}, '(?i)^(rgb|hsl)a?\s*\(') THEN 'color' WHEN regexp_matches({t}, '(?i)^-?\d+(\.\d+)?({UNITS})?$') THEN 'numero' ELSE 'otro' END"


def gate(p: str) -> str:
    on = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {str(v).lower()}" for k, v in PROPERTIES.items()) + " END"
    return f"coalesce({on(p)}, {on(f"split_part({p}, '-', 1)")}, false)"


def allowed(v: str) -> str:
    return f"lower({trim(v)}) IN {_in(a.lower() for a in ALLOWED)}"


def matched(source: str, text: str, pattern: str, keep: str, prefix: str) -> str:
    """Rows of a source with each match of a pattern: <prefix>_m, <prefix>_ord, <prefix>_off (from 0)."""
    return f"""SELECT {keep}, ms[i] AS {prefix}_m, CAST(i - 1 AS INTEGER) AS {prefix}_ord,
 CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS {prefix}_off
 FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}', 0) AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {source}))"""


def line(text: str, off: str) -> str:
    return f"CAST(length(substr({text}, 1, {off})) - length(replace(substr({text}, 1, {off}), chr(10), '')) AS INTEGER)"


def col(text: str, off: str) -> str:
    return f"CAST(length(regexp_extract(substr({text}, 1, {off}), '[^\\n]*$')) AS INTEGER)"


FILES = f"tokens AS ({TOKENS_SQL}), sheets AS ({SHEETS_SQL}), components AS ({COMPONENTS_SQL}), files AS (SELECT * FROM tokens UNION ALL SELECT * FROM sheets UNION ALL SELECT * FROM components), styles AS (SELECT * FROM tokens UNION ALL SELECT * FROM sheets)"
DEFS = f"""defm AS ({matched('tokens', 'text', DEFINITION, 'path, text', 'd')}), defs AS (
 SELECT path, regexp_extract(d_m, '{DEFINITION}', 1) AS name, {clean(f"regexp_extract(d_m, '{DEFINITION}', 2)")} AS value, {line('text', 'd_off')} AS line, {col('text', 'd_off')} AS col, d_off FROM defm)"""
INDEX = f"idx AS (SELECT *, {is_color('value')} AS is_color FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, d_off) AS r FROM defs) WHERE r = 1)"
PARSE = f"""blanked AS (
 SELECT path, lang, text, array_to_string(list_transform(list_zip(string_split_regex(text, '{COMMENT}'), regexp_extract_all(text, '{COMMENT}', 0)), lambda z: coalesce(z[1], '') || repeat(' ', length(coalesce(z[2], '')))), '') AS blank FROM styles
), rulem AS ({matched('blanked', 'blank', RULE, 'path, lang, text', 'r')}), rul AS (
 SELECT *, regexp_extract(r_m, '{RULE}', 1) AS head, regexp_extract(r_m, '{RULE}', 2) AS content FROM rulem
), declm AS ({matched('rul', 'content', DECLARATION, 'path, lang, text, r_ord, r_off, head', 'd')}), decl1 AS (
 SELECT *, regexp_extract(d_m, '{DECLARATION}', 1) AS property, regexp_extract(d_m, '{DECLARATION}', 2) AS raw, r_off + length(head) + 1 + d_off AS prop_at FROM declm
), decl AS (
 SELECT *, {clean('raw')} AS value, CAST(prop_at + instr(d_m, raw) - 1 + length(raw) - length(ltrim(raw)) AS INTEGER) AS value_at FROM decl1
), usem AS ({matched('decl', 'value', VAR, 'path, r_ord, d_ord, property, value, text, value_at', 'u')}), uses AS (
 SELECT path, r_ord AS rule_ord, d_ord AS decl_ord, u_ord AS use_ord, property, regexp_extract(u_m, '{VAR}', 1) AS name, nullif({trim(f"regexp_extract(u_m, '{VAR}', 2)")}, '') AS fallback,
 {line('text', 'value_at + u_off')} AS start_line, {col('text', 'value_at + u_off')} AS start_col, {line('text', 'value_at + u_off + length(u_m)')} AS end_line, {col('text', 'value_at + u_off + length(u_m)')} AS end_col FROM usem
), decls AS (
 SELECT path, r_ord AS rule_ord, d_ord AS decl_ord, {trim('head')} AS selector, property, value, regexp_matches(property, '^\\s*(--[\\w-]+)\\s*$') AS is_definition,
 {line('text', 'prop_at')} AS prop_line, {col('text', 'prop_at')} AS prop_col, {line('text', 'value_at')} AS start_line, {col('text', 'value_at')} AS start_col, {line('text', 'value_at + length(value)')} AS end_line, {col('text', 'value_at + length(value)')} AS end_col FROM decl
)"""
EXPRESSION = r"style\s*=\s*\{(\s*[^}{\s][^}]*|\s+)\}"
OBJECT = r"style\s*=\s*\{\s*\{"
INLINE = f"""exprm AS ({matched('components', 'text', EXPRESSION, 'path, text', 'e')}), objm AS ({matched('components', 'text', OBJECT, 'path, text', 'e')}), obje AS (
 SELECT *, e_off + length(e_m) AS at0, string_split(substr(text, e_off + length(e_m) + 1), '') AS chars FROM objm
), objend AS (
 SELECT *, coalesce(at0 + list_filter(range(1, len(chars) + 1), lambda i: 2 + list_sum(list_transform(chars[1:i], lambda c: CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)) = 0)[1], length(text)) AS e_end FROM obje
), inline AS (
 SELECT path, 0 AS phase, e_ord AS ord, 'CSS inline detectado — usa clases CSS con variables en vez de style=@@' AS message, {line('text', 'e_off')} AS start_line, {col('text', 'e_off')} AS start_col, {line('text', 'CAST(e_end AS INTEGER)')} AS end_line, {col('text', 'CAST(e_end AS INTEGER)')} AS end_col FROM objend
 UNION ALL
 SELECT path, 1, e_ord, 'CSS inline detectado (style={{' || {trim(f"regexp_extract(e_m, '{EXPRESSION}', 1)")} || '}}) — usa clases CSS con variables', {line('text', 'e_off')}, {col('text', 'e_off')}, {line('text', 'e_off + length(e_m)')}, {col('text', 'e_off + length(e_m)')} FROM exprm
)""".replace("{{", "{").replace("}}", "}").replace("@@", "{{}}")
RANGE = "start_line, start_col, end_line, end_col"
DIAG = f"""diag AS (
 SELECT path, 0 AS phase, rule_ord AS o0, decl_ord AS o1, use_ord AS o2, 'variableNoDefinida' AS kind, 0 AS severity, 'Variable ''' || name || ''' no está definida' AS message, NULL AS value, name AS var_name, {RANGE} FROM uses WHERE name NOT IN (SELECT name FROM idx)
 UNION ALL SELECT path, 1, rule_ord, decl_ord, use_ord, 'valorHardcoded', 1, 'Valor hardcodeado ''' || fallback || ''' en ''' || property || ''' - considera usar una variable CSS', fallback, NULL, {RANGE} FROM uses WHERE fallback IS NOT NULL AND {hardcoded('fallback')}
 UNION ALL SELECT path, 2, rule_ord, decl_ord, 0, 'valorHardcoded', 1, 'Valor hardcodeado ''' || value || ''' en ''' || property || ''' - considera usar una variable CSS', value, NULL, {RANGE} FROM decls WHERE NOT is_definition AND {gate('property')} AND NOT {allowed('value')} AND {hardcoded('value')}
 UNION ALL SELECT path, phase, ord, 0, 0, 'cssInlineReact', 0, message, NULL, NULL, {RANGE} FROM inline
)"""
REPORT = """rep AS (
 SELECT path, count(*) AS total, count(*) FILTER (WHERE severity = 0) AS errors, count(*) FILTER (WHERE severity = 1) AS warnings, count(*) FILTER (WHERE severity = 2) AS info, count(*) FILTER (WHERE severity = 3) AS hints,
 list_transform(list('L' || (start_line + 1) || ': ' || message ORDER BY phase, o0, o1, o2)[1:3], lambda x: x) AS examples FROM diag GROUP BY path
), tot AS (SELECT CAST((SELECT count(*) FROM diag) AS BIGINT) AS total_diagnostics, (SELECT count(*) FROM files) AS files_analyzed, (SELECT count(*) FROM rep) AS files_with_problems)"""
ALL = f"{FILES}, {DEFS}, {INDEX}, {PARSE}, {INLINE}, {DIAG}, {REPORT}"
RESOLVE = f"""walk AS (
 SELECT name, 1 AS depth, name AS cur, value AS cur_value, [name] AS chain, [value] AS vals, CASE WHEN regexp_matches(value, '{VAR}') THEN regexp_extract(value, '{VAR}', 1) END AS next FROM idx
 UNION ALL
 SELECT w.name, depth + 1, i.name, i.value, list_append(w.chain, i.name), list_append(w.vals, i.value), CASE WHEN regexp_matches(i.value, '{VAR}') THEN regexp_extract(i.value, '{VAR}', 1) END
 FROM walk w JOIN idx i ON i.name = w.next WHERE NOT list_contains(w.chain, w.next) AND depth < 10
), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth DESC) AS r FROM walk) WHERE r = 1
), fold AS (
 SELECT name, depth AS k, vals[depth] AS acc FROM last
 UNION ALL
 SELECT f.name, k - 1, CASE WHEN instr(l.vals[k - 1], 'var(' || l.chain[k] || ')') > 0 THEN substr(l.vals[k - 1], 1, instr(l.vals[k - 1], 'var(' || l.chain[k] || ')') - 1) || acc || substr(l.vals[k - 1], instr(l.vals[k - 1], 'var(' || l.chain[k] || ')') + length(l.chain[k]) + 5) ELSE l.vals[k - 1] END
 FROM fold f JOIN last l ON l.name = f.name WHERE k > 1
), res AS (
 SELECT l.name, l.vals[1] AS value, f.acc AS resolved_value, CASE WHEN l.next IS NOT NULL AND l.next NOT IN (SELECT name FROM idx) AND l.depth < 10 THEN list_append(l.chain, l.next) ELSE l.chain END AS chain,
 CASE WHEN l.next IS NULL THEN 'literal' WHEN list_contains(l.chain, l.next) THEN 'cycle' WHEN l.depth = 10 THEN 'depth' ELSE 'missing' END AS stop
 FROM last l JOIN fold f ON f.name = l.name AND f.k = 1
)"""
WITH_RES = f"WITH RECURSIVE {FILES}, {DEFS}, {INDEX}, {RESOLVE}"


def color_parts(v: str) -> str:
    """Columns f, r, g, b, a, hex of a source's value as a subquery; null where it is no colour."""
    c = f"lower({trim(v)})"
    one = lambda k: f"CAST('0x' || substr({c}, {k}, 1) || substr({c}, {k}, 1) AS INTEGER)"
    two = lambda k: f"CAST('0x' || substr({c}, {k}, 2) AS INTEGER)"
    part = lambda f, k: f"regexp_extract({v}, '{FORMS[f]}', {k})"
    num = lambda f, k: f"CAST({part(f, k)} AS INTEGER)"
    code = "CASE " + " ".join(f"WHEN {c} = '{n}' THEN '{x}'" for n, x in NAMED.items()) + " END"
    alpha = lambda x: rf"TRY_CAST(regexp_extract({x}, '^(\d+\.?\d*|\.\d+)', 1) AS DOUBLE)"
    modern = lambda f: f"CASE WHEN {part(f, 4)} = '' THEN 1.0 WHEN suffix({part(f, 4)}, '%') THEN {alpha(part(f, 4))} / 100 ELSE {alpha(part(f, 4))} END"
    rows = [f"WHEN {c} IN {_in(NAMED)} THEN struct_pack(f := 'named', x := CASE WHEN {code} = 'transparent' THEN [0, 0, 0] ELSE [CAST('0x' || substr({code}, 2, 2) AS INTEGER), CAST('0x' || substr({code}, 4, 2) AS INTEGER), CAST('0x' || substr({code}, 6, 2) AS INTEGER)] END, h := false, a := CASE WHEN {code} = 'transparent' THEN 0.0 ELSE 1.0 END::DOUBLE)"]
    for size, get in ((3, one), (4, one), (6, two), (8, two)):
        at = (2, 3, 4, 5) if size < 5 else (2, 4, 6, 8)
        a = f"{get(at[3])} / 255.0" if size in (4, 8) else "1.0"
        rows.append(f"WHEN regexp_matches({c}, '^#[0-9a-f]{{{size}}}$') THEN struct_pack(f := 'hex', x := [{get(at[0])}, {get(at[1])}, {get(at[2])}], h := false, a := ({a})::DOUBLE)")
    for f in FORMS:
        a = alpha(part(f, 4)) if f.endswith("a") else modern(f) if f.endswith("m") else "1.0"
        rows.append(f"WHEN regexp_matches({v}, '{FORMS[f]}') THEN struct_pack(f := {f"CASE WHEN {a} < 1 THEN '{f[:3]}a' ELSE '{f[:3]}' END" if f.endswith('m') else f"'{f}'"}, x := [{num(f, 1)}, {num(f, 2)}, {num(f, 3)}], h := {str(f[0] == 'h').lower()}, a := ({a})::DOUBLE)")
    return "CASE " + " ".join(rows) + " END"


def with_color(source: str, v: str, keep: str) -> str:
    """SELECT of keep and f, r, g, b, a for each row of a source."""
    ladder = lambda *six: "CASE " + " ".join(f"WHEN x[1] < {60 * (k + 1)} THEN {e}" for k, e in enumerate(six)) + " ELSE 0.0 END"
    rgb = lambda k: f"CASE WHEN h THEN CAST(floor(({(ladder('cc', 'xx', '0.0', '0.0', 'xx', 'cc'), ladder('xx', 'cc', 'cc', 'xx', '0.0', '0.0'), ladder('0.0', '0.0', 'xx', 'cc', 'cc', 'xx'))[k]} + mm) * 255 + 0.5) AS INTEGER) ELSE x[{k + 1}] END"
    return f"""SELECT {keep}, f, {rgb(0)} AS r, {rgb(1)} AS g, {rgb(2)} AS b, a FROM (
 SELECT *, cc * (1 - abs(fmod(x[1] / 60.0::DOUBLE, 2) - 1)) AS xx, ll - cc / 2 AS mm FROM (
 SELECT *, (1 - abs(2 * ll - 1)) * (x[2] / 100.0::DOUBLE) AS cc FROM (
 SELECT {keep}, c.f AS f, c.x AS x, c.h AS h, c.a AS a, c.x[3] / 100.0::DOUBLE AS ll FROM (SELECT *, {color_parts(v)} AS c FROM {source}))))"""


def hex_of(r: str, g: str, b: str, a: str) -> str:
    two = lambda x: f"lpad(lower(to_hex(CAST(least(255, greatest(0, floor({x} + 0.5))) AS BIGINT))), 2, '0')"
    return f"'#' || {two(r)} || {two(g)} || {two(b)} || CASE WHEN {a} < 1 THEN {two(f'({a}) * 255')} ELSE '' END"


VALUES = f"vals AS ({VALUES_SQL})"
CURSORS = f"cur AS ({CURSORS_SQL}), curline AS (SELECT c.*, coalesce(string_split(s.text, chr(10))[c.line + 1], '') AS t FROM cur c JOIN sheets s ON s.path = c.path)"
NAME_AT = f"""callm AS ({matched('curline', 't', VAR, 'cursor_id, path, line, col, t', 'u')}), dfm AS ({matched('curline', 't', r'(--[\w-]+)\s*:', 'cursor_id, path, line, col, t', 'u')}), atc AS (
 SELECT cursor_id, 0 AS p, u_off, regexp_extract(u_m, '{VAR}', 1) AS name, u_off + instr(u_m, regexp_extract(u_m, '{VAR}', 1)) - 1 AS s FROM callm WHERE col BETWEEN u_off AND u_off + length(u_m)
 UNION ALL SELECT cursor_id, 1, u_off, regexp_extract(u_m, '(--[\\w-]+)', 1), u_off FROM dfm WHERE col BETWEEN u_off AND u_off + length(regexp_extract(u_m, '(--[\\w-]+)', 1))
), at1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cursor_id ORDER BY p, u_off) AS r FROM atc) WHERE r = 1)"""
PROPERTY_AT = r"CASE WHEN regexp_matches(t, '^\s*([a-zA-Z-]+)\s*:\s*') AND col > instr(t, ':') - 1 THEN regexp_extract(t, '^\s*([a-zA-Z-]+)\s*:\s*', 1) END"


def _context() -> str:
    before = "substr(t, 1, col)"
    rest = f"substr({before}, length({before}) - instr(reverse({before}), reverse('var(')) + 2)"
    opened = f"contains({before}, 'var(') AND len(list_filter(range(1, length({rest}) + 1), lambda i: 1 + length(replace(substr({rest}, 1, i), ')', '')) - length(replace(substr({rest}, 1, i), '(', '')) <= 0)) = 0"
    return rf"""ctx0 AS (SELECT cursor_id, ({opened}) OR regexp_matches({before}, 'var\((--[\w-]*)?$') AS inside, regexp_matches({before}, ':\s*[\w-]*$') AS can, {PROPERTY_AT} AS property, regexp_replace(regexp_extract({before}, 'var\((-*[\w-]*)$', 1), '^-+', '') AS part FROM curline),
 ctx AS (SELECT cursor_id, CASE WHEN inside THEN 'name' ELSE 'call' END AS mode, property, CASE WHEN inside THEN part ELSE '' END AS filter FROM ctx0 WHERE inside OR can)"""


KEYS = "CASE property " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in KEYWORDS.items()) + " ELSE [] END"
IS_COLOR_PROPERTY = "coalesce(" + " OR ".join(f"contains(property, '{p}')" for p in COLOR_HINTS) + ", false)"
COMPLETIONS = f"""{WITH_RES}, {CURSORS}, {_context()}, asked AS (SELECT DISTINCT mode, property, filter, {KEYS} AS words FROM ctx
), scored AS (
 SELECT mode, property, filter, i.name, i.path, i.d_off, 50 * len(list_filter(words, lambda w: contains(lower(i.name), w))) + CASE WHEN filter <> '' THEN 30 ELSE 0 END + CASE WHEN {IS_COLOR_PROPERTY} AND i.is_color THEN 40 ELSE 0 END AS relevance
 FROM asked JOIN idx i ON contains(lower(i.name), lower(filter))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY mode, property, filter ORDER BY relevance DESC, path, d_off) AS rank FROM scored)
SELECT c.cursor_id, c.mode, CAST(r.rank AS INTEGER) AS rank, CASE WHEN c.mode = 'call' THEN 'var(' || r.name || ')' ELSE r.name END AS label, CAST(r.relevance AS BIGINT) AS relevance, lpad(CAST(r.rank - 1 AS VARCHAR), 4, '0') AS sort_text
FROM ctx c JOIN ranked r ON c.mode = r.mode AND c.property IS NOT DISTINCT FROM r.property AND c.filter = r.filter WHERE r.rank <= CASE WHEN c.mode = 'name' THEN 50 ELSE 5 END"""
SIMILAR = f"""WITH {FILES}, {DEFS}, {INDEX}, {PARSE}, names AS (SELECT DISTINCT name FROM uses WHERE name NOT IN (SELECT name FROM idx)), sim AS (
 SELECT n.name AS var_name, i.name AS candidate, i.path, i.d_off, (greatest(length(n.name), length(i.name)) - levenshtein(n.name, i.name)) / CAST(greatest(length(n.name), length(i.name)) AS DOUBLE) AS similarity
 FROM names n JOIN idx i ON 2 * least(length(n.name), length(i.name)) > greatest(length(n.name), length(i.name))
), rk AS (SELECT *, row_number() OVER (PARTITION BY var_name ORDER BY similarity DESC, path, d_off) AS rank FROM sim WHERE similarity > 0.5)
SELECT var_name, CAST(rank AS INTEGER) AS rank, candidate, round(similarity, 6) AS similarity FROM rk WHERE rank <= 3"""
SUGGEST = f"""{WITH_RES}, {PARSE}, {VALUES}, asked AS (SELECT DISTINCT value FROM vals), known AS (
 SELECT i.name, i.path, i.d_off, i.is_color, coalesce(nullif(r.resolved_value, ''), i.value) AS text FROM idx i JOIN res r ON r.name = i.name
), kc AS ({with_color('(SELECT * FROM known WHERE is_color)', 'text', 'name, path, d_off, text')}), ac AS ({with_color(f'(SELECT * FROM asked WHERE {is_color("value")})', 'value', 'value')}), hits AS (
 SELECT a.value, k.name, k.path, k.d_off, 100.0::DOUBLE AS score FROM asked a JOIN known k ON lower({trim('k.text')}) = lower({trim('a.value')}) WHERE k.text <> ''
 UNION ALL SELECT a.value, k.name, k.path, k.d_off, 50.0::DOUBLE - sqrt(pow(a.r - k.r, 2) + pow(a.g - k.g, 2) + pow(a.b - k.b, 2)) / 5 FROM ac a JOIN kc k ON lower({trim('k.text')}) <> lower({trim('a.value')}) WHERE a.f IS NOT NULL AND k.f IS NOT NULL
), rk AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, path, d_off) AS rank FROM hits WHERE score > 10)
SELECT value, CAST(rank AS INTEGER) AS rank, name AS candidate, round(score, 6) AS score FROM rk WHERE rank <= 3"""
HOVER_SIMILAR = f"""WITH {FILES}, {DEFS}, {INDEX}, {PARSE}, names AS (SELECT DISTINCT name FROM uses WHERE name NOT IN (SELECT name FROM idx)), w AS (
 SELECT name, list_filter(string_split(regexp_replace(lower(name), '--', ''), '-'), lambda x: length(x) >= 2) AS mine FROM names
), k AS (SELECT name, path, d_off, string_split(regexp_replace(lower(name), '--', ''), '-') AS theirs FROM idx), sc AS (
 SELECT w.name, k.name AS candidate, k.path, k.d_off, CAST(10 * coalesce(list_sum(list_transform(mine, lambda a: len(list_filter(theirs, lambda b: contains(b, a) OR contains(a, b))))), 0) + CASE WHEN starts_with(lower(k.name), substr(lower(w.name), 1, 5)) THEN 5 ELSE 0 END AS INTEGER) AS points FROM w, k
), rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY points DESC, path, d_off) AS rank FROM sc WHERE points > 0)
SELECT name, CAST(rank AS INTEGER) AS rank, candidate, points FROM rk WHERE rank <= 3"""
LUMINANCE = lambda p: " + ".join(f"{w} * CASE WHEN {p}{c} / 255.0::DOUBLE <= 0.03928 THEN {p}{c} / 255.0::DOUBLE / 12.92 ELSE pow(({p}{c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END" for c, w in (("r", 0.2126), ("g", 0.7152), ("b", 0.0722)))
NEAREST = "list_sort(list_transform([" + ", ".join(f"struct_pack(k := {k}, n := '{n}', r := {int(x[1:3], 16)}, g := {int(x[3:5], 16)}, b := {int(x[5:7], 16)})" for k, (n, x) in enumerate((n, x) for n, x in NAMED.items() if n != "transparent")) + "], lambda t: struct_pack(d := sqrt(pow(r - t.r, 2) + pow(g - t.g, 2) + pow(b - t.b, 2)), k := t.k, n := t.n)))[1]"
GLOB = lambda p, globs: "(" + " OR ".join(f"regexp_matches({p}, '{glob_regex(g)}')" for g in globs) + ")"
PAINT = f"paint AS ({with_color('vals', 'value', 'case_id, value')})"

SHADES = f"shade0 AS (SELECT r.name, coalesce(nullif(r.resolved_value, ''), r.value) AS final FROM res r), shade1 AS ({with_color('shade0', 'final', 'name, final')}), shade AS (SELECT *, CASE WHEN f = 'named' AND a = 0 THEN '#00000000' WHEN f = 'hex' AND length({trim('final')}) IN (7, 9) THEN lower({trim('final')}) ELSE {hex_of('r', 'g', 'b', 'a')} END AS hex FROM shade1 WHERE f IS NOT NULL)"


def preview(code: str, original: str) -> str:
    """Markdown preview of a colour whose r, g, b and a are columns."""
    svg = f"'<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"16\" height=\"16\">' || chr(10) || '        <rect width=\"16\" height=\"16\" fill=\"' || {code} || '\" stroke=\"#888\" stroke-width=\"1\"/>' || chr(10) || '    </svg>'"
    return f"'![color](data:image/svg+xml;base64,' || base64(encode({svg})) || ') **' || {original} || '**' || chr(10) || chr(10) || '- **HEX:** `' || {code} || '`' || chr(10) || '- **RGB:** `rgb(' || r || ', ' || g || ', ' || b || ')`' || CASE WHEN a < 1 THEN chr(10) || '- **Alpha:** `' || printf('%.2f', a) || '`' ELSE '' END"


GAP = "chr(10) || chr(10)"
CHAIN = "array_to_string(list_transform(r.chain, lambda n: '`' || n || '`'), ' → ')"
HOVER = f"""{WITH_RES}, {SHADES}, {CURSORS}, {NAME_AT}, shown AS (
 SELECT r.name, '### `' || r.name || '`' || {GAP} || coalesce(s.picture || {GAP} || '---' || {GAP}, '') || '**Valor:** `' || r.value || '`' || {GAP}
  || CASE WHEN r.resolved_value <> r.value THEN '**Valor Resuelto:** `' || r.resolved_value || '`' || {GAP} ELSE '' END
  || CASE WHEN r.resolved_value <> r.value AND len(r.chain) > 1 THEN '**Cadena:** ' || {CHAIN} || {GAP} ELSE '' END
  || '---' || {GAP} || '📁 **Definido en:** [' || i.path || ':' || (i.line + 1) || '](file://' || i.path || '#L' || (i.line + 1) || ')' || {GAP} AS markdown
 FROM res r JOIN idx i ON i.name = r.name LEFT JOIN (SELECT name, {preview('hex', 'final')} AS picture FROM shade) s ON s.name = r.name
) SELECT a.cursor_id, a.name, c.line AS doc_line, CAST(a.s AS INTEGER) AS start_col, CAST(a.s + length(a.name) AS INTEGER) AS end_col, w.markdown FROM at1 a JOIN cur c ON c.cursor_id = a.cursor_id LEFT JOIN shown w ON w.name = a.name"""
HOVER_MISSING = HOVER_SIMILAR.replace("SELECT name, CAST(rank AS INTEGER) AS rank, candidate, points FROM rk WHERE rank <= 3", """SELECT n.name, '### ⚠️ Variable No Encontrada' || chr(10) || chr(10) || 'La variable `' || n.name || '` no está definida en ninguno de los archivos de variables configurados.' || chr(10) || chr(10) || coalesce('**¿Quisiste decir?**' || chr(10) || s.lines, '') AS markdown
FROM names n LEFT JOIN (SELECT name, string_agg('- `' || candidate || '`' || chr(10), '' ORDER BY rank) AS lines FROM rk WHERE rank <= 3 GROUP BY name) s ON s.name = n.name""")
SUGGESTED = SUGGEST[SUGGEST.index("known AS (") : SUGGEST.index("\nSELECT value, CAST(rank")]
SIMILAR_RANKED = SIMILAR[SIMILAR.index("names AS (") : SIMILAR.index("\nSELECT var_name")].replace("rk AS", "srk AS")
ACTIONS = f"""{WITH_RES}, {PARSE}, {INLINE}, {DIAG}, asked AS (SELECT DISTINCT value FROM diag WHERE kind = 'valorHardcoded'), {SUGGESTED}, {SIMILAR_RANKED}, lined AS (
 SELECT DISTINCT d.path, d.start_line, d.var_name, coalesce(string_split(f.text, chr(10))[d.start_line + 1], '') AS line FROM diag d JOIN files f ON f.path = d.path WHERE d.kind = 'variableNoDefinida'
), called AS (SELECT *, regexp_extract(line, 'var\\(\\s*' || var_name || '\\s*') AS call FROM lined
), act AS (
 SELECT d.path, phase, o0, o1, o2, kind, {RANGE}, CAST(rank AS INTEGER) AS rank, 'Reemplazar con var(' || name || ')' AS title, start_line AS edit_line, start_col AS edit_start, end_line AS edit_end_line, end_col AS edit_end, 'var(' || name || ')' AS new_text, rank = 1 AS is_preferred
 FROM diag d JOIN rk ON rk.value = d.value WHERE kind = 'valorHardcoded' AND rank <= 3
 UNION ALL
 SELECT d.path, phase, o0, o1, o2, kind, d.start_line, start_col, end_line, end_col, CAST(rank AS INTEGER), '¿Quisiste decir var(' || candidate || ')?', CASE WHEN call <> '' THEN d.start_line END, CASE WHEN call <> '' THEN CAST(instr(line, call) - 1 AS INTEGER) END, CASE WHEN call <> '' THEN d.start_line END, CASE WHEN call <> '' THEN CAST(instr(line, call) - 1 + length(call) AS INTEGER) END, CASE WHEN call <> '' THEN 'var(' || candidate END, false
 FROM diag d JOIN srk ON srk.var_name = d.var_name JOIN called c ON c.path = d.path AND c.start_line = d.start_line AND c.var_name = d.var_name WHERE kind = 'variableNoDefinida' AND rank <= 3
)"""
_AT = lambda line, col: f"least(length(text), coalesce(list_sum(list_transform(string_split(text, chr(10))[1:{line}], lambda x: length(x) + 1)), 0)) + {col}"
FIXED = f"""chosen AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, {RANGE} ORDER BY is_preferred DESC, phase, o0, o1, o2, rank) AS pick FROM act) WHERE pick = 1 AND new_text IS NOT NULL
), placed AS (
 SELECT path, text, list({{'s': s, 'e': e, 'x': new_text}} ORDER BY s DESC, e DESC, new_text DESC) AS edits FROM (
  SELECT c.path, text, new_text, CAST({_AT('edit_line', 'edit_start')} AS INTEGER) AS s, CAST({_AT('edit_end_line', 'edit_end')} AS INTEGER) AS e FROM chosen c JOIN styles f ON f.path = c.path
 ) GROUP BY path, text
), fixing AS (
 SELECT path, edits, text, CAST(length(text) AS INTEGER) AS low, 0 AS n, 1 AS k FROM placed
 UNION ALL
 SELECT path, edits, CASE WHEN edits[k].e <= low THEN substr(text, 1, edits[k].s) || edits[k].x || substr(text, edits[k].e + 1) ELSE text END, CASE WHEN edits[k].e <= low THEN edits[k].s ELSE low END, CASE WHEN edits[k].e <= low THEN n + 1 ELSE n END, k + 1 FROM fixing WHERE k <= len(edits)
), fixed AS (SELECT path, text, n AS n_fixes FROM fixing WHERE k = len(edits) + 1)"""


def _again(sql: str) -> str:
    """The same tables over the fixed documents, under names of their own."""
    for name in ("sheets", "files", "styles", "tokens", "defm", "defs", "idx", "blanked", "rulem", "rul", "declm", "decl1", "decl", "usem", "uses", "decls", "diag", "rep", "tot"):
        sql = re.sub(rf"\b{name}\b", f"{name}_2", sql)
    return sql


AFTER = f"""sheets_2 AS (SELECT s.path, s.lang, coalesce(f.text, s.text) AS text FROM sheets s LEFT JOIN fixed f ON f.path = s.path), tokens_2 AS (SELECT s.path, s.lang, coalesce(f.text, s.text) AS text FROM tokens s LEFT JOIN fixed f ON f.path = s.path),
files_2 AS (SELECT * FROM tokens_2 UNION ALL SELECT * FROM sheets_2 UNION ALL SELECT * FROM components), styles_2 AS (SELECT * FROM tokens_2 UNION ALL SELECT * FROM sheets_2), {_again(DEFS)}, {_again(INDEX)}, {_again(PARSE)}, {_again(DIAG)}, {_again(REPORT)}"""
SPLIT = f"""WITH RECURSIVE {VALUES}, walk AS (
 SELECT case_id, value, 0 AS k, 0 AS depth, '' AS part, CAST([] AS VARCHAR[]) AS parts FROM vals
 UNION ALL
 SELECT case_id, value, k + 1, depth + CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, CASE WHEN ch = ' ' AND depth = 0 THEN '' ELSE part || ch END, CASE WHEN ch = ' ' AND depth = 0 AND {trim('part')} <> '' THEN list_append(parts, {trim('part')}) ELSE parts END
 FROM (SELECT *, substr(value, k + 1, 1) AS ch FROM walk WHERE k < length(value))
) SELECT case_id, array_to_string(CASE WHEN {trim('part')} <> '' THEN list_append(parts, {trim('part')}) ELSE parts END, '|') AS parts FROM walk WHERE k = length(value)"""

SQL = {
    "definitions": f"WITH {FILES}, {DEFS} SELECT path, name, value, line, col, {is_color('value')} AS is_color FROM defs",
    "definitions_per_file": f"WITH {FILES}, {DEFS} SELECT path, count(*) AS n_definitions FROM defs GROUP BY path",
    "variable_index": f"WITH {FILES}, {DEFS}, {INDEX} SELECT name, value, path, line, col, is_color FROM idx",
    "index_stats": f"WITH {FILES}, {DEFS}, {INDEX} SELECT (SELECT count(*) FROM idx) AS n_variables, (SELECT count(*) FROM tokens) AS n_files",
    "rules": f"WITH {FILES}, {PARSE} SELECT path, r_ord AS rule_ord, {trim('head')} AS selector, content, {line('text', 'r_off')} AS rule_line, {col('text', 'r_off')} AS rule_col FROM rul",
    "declarations": f"WITH {FILES}, {PARSE} SELECT path, rule_ord, decl_ord, selector, property, value, is_definition, prop_line, prop_col, {RANGE} FROM decls",
    "var_uses": f"WITH {FILES}, {PARSE} SELECT path, rule_ord, decl_ord, use_ord, property, name, fallback, {RANGE} FROM uses",
    "rule_definitions": f"WITH {FILES}, {PARSE} SELECT path, rule_ord, decl_ord, property AS name, value, {is_color('value')} AS is_color, prop_line AS line, prop_col AS col FROM decls WHERE is_definition",
    "document_uses": f"WITH {FILES}, m AS ({matched('styles', 'text', VAR, 'path, text', 'u')}) SELECT path, u_ord AS use_ord, regexp_extract(u_m, '{VAR}', 1) AS name, nullif({trim(f"regexp_extract(u_m, '{VAR}', 2)")}, '') AS fallback, {line('text', 'u_off')} AS line, {col('text', 'u_off')} AS col FROM m",
    "undefined_uses": f"WITH {FILES}, {DEFS}, {INDEX}, {PARSE} SELECT path, name, start_line, start_col FROM uses WHERE name NOT IN (SELECT name FROM idx)",
    "defined_uses": f"WITH {FILES}, {DEFS}, {INDEX}, {PARSE} SELECT path, name, start_line, start_col FROM uses WHERE name IN (SELECT name FROM idx)",
    "hardcoded_values": f"WITH {FILES}, {PARSE} SELECT path, rule_ord, decl_ord, property, value, {RANGE} FROM decls WHERE NOT is_definition AND {gate('property')} AND NOT {allowed('value')} AND {hardcoded('value')}",
    "hardcoded_fallbacks": f"WITH {FILES}, {PARSE} SELECT path, rule_ord, decl_ord, use_ord, property, fallback, {RANGE} FROM uses WHERE fallback IS NOT NULL AND {hardcoded('fallback')}",
    "inline_expressions": f"WITH {FILES}, {INLINE} SELECT path, ord, message, {RANGE} FROM inline WHERE phase = 1",
    "inline_objects": f"WITH {FILES}, {INLINE} SELECT path, ord, message, {RANGE} FROM inline WHERE phase = 0",
    "diagnostics": f"WITH {ALL} SELECT path, phase, o0, o1, o2, kind, severity, message, value, var_name, {RANGE} FROM diag",
    "file_report": f"WITH {ALL} SELECT path, total, errors, warnings, info, hints, array_to_string(examples, '|') AS examples FROM rep",
    "project_report": f"WITH {ALL} SELECT tot.*, path, total, errors, warnings, info, hints, array_to_string(examples, '|') AS examples FROM tot LEFT JOIN rep ON true ORDER BY errors DESC, total DESC, path",
    "report_lines": f"WITH {ALL} SELECT NULL AS path, NULL::BIGINT AS errors, NULL::BIGINT AS total, '{TITLE}' || chr(10) || 'Total diagnósticos: ' || total_diagnostics || chr(10) || 'Archivos analizados: ' || files_analyzed || chr(10) || 'Archivos con problemas: ' || files_with_problems || chr(10) AS text FROM tot UNION ALL SELECT path, errors, total, '• ' || path || chr(10) || '  Total: ' || total || ' | Errores: ' || errors || ' | Warnings: ' || warnings || ' | Info: ' || info || ' | Hint: ' || hints || chr(10) || array_to_string(list_transform(examples, lambda x: '    - ' || x || chr(10)), '') FROM rep",
    "report_quick_list": f"WITH {ALL} SELECT CASE WHEN errors > 0 THEN '$(error) ' ELSE '$(warning) ' END || regexp_extract(path, '[^/]*$') AS label, total || ' problema(s) · E:' || errors || ' W:' || warnings AS description, path AS detail FROM rep",
    "resolved_variables": f"{WITH_RES} SELECT name, true AS found, value, resolved_value, {is_color('resolved_value')} AS is_color FROM res",
    "alias_chains": f"{WITH_RES} SELECT name, array_to_string(chain, ' > ') AS chain, CAST(len(chain) AS INTEGER) AS n FROM res",
    "resolution_stop_reason": f"{WITH_RES} SELECT stop, count(*) AS n FROM res GROUP BY stop",
    "similar_names_top3": SIMILAR,
    "suggest_for_value_top3": SUGGEST,
    "completions": COMPLETIONS,
    "hover_similar_top3": HOVER_SIMILAR,
    "variable_at_cursor": f"WITH {FILES}, {CURSORS}, {NAME_AT} SELECT cursor_id, name, CAST(s AS INTEGER) AS start_col, CAST(s + length(name) AS INTEGER) AS end_col FROM at1",
    "property_at_cursor": f"WITH {FILES}, {CURSORS} SELECT cursor_id, {PROPERTY_AT} AS property FROM curline WHERE {PROPERTY_AT} IS NOT NULL",
    "goto_definition": rf"WITH {FILES}, {DEFS}, {INDEX}, {CURSORS}, m AS ({matched('curline', 't', r'var\(\s*(--[\w-]+)', 'cursor_id, col', 'u')}), f AS (SELECT cursor_id, regexp_extract(u_m, '(--[\w-]+)', 1) AS name, row_number() OVER (PARTITION BY cursor_id ORDER BY u_off) AS r FROM m WHERE col BETWEEN u_off AND u_off + length(u_m)) SELECT cursor_id, f.name, idx.path AS target_path, idx.line AS target_line, idx.col AS target_col FROM f LEFT JOIN idx ON idx.name = f.name WHERE f.r = 1",
    "is_color": f"WITH {VALUES} SELECT case_id, {is_color('value')} AS is_color FROM vals",
    "is_hardcoded": f"WITH {VALUES} SELECT case_id, {hardcoded('value')} AS is_hardcoded FROM vals",
    "parse_color": f"WITH {VALUES}, {PAINT} SELECT case_id, f AS format, r, g, b, round(a, 6) AS a, CASE WHEN f = 'named' AND a = 0 THEN '#00000000' WHEN f = 'hex' AND length({trim('value')}) IN (7, 9) THEN lower({trim('value')}) ELSE {hex_of('r', 'g', 'b', 'a')} END AS hex FROM paint WHERE f IS NOT NULL",
    "contrast": f"WITH {VALUES}, {PAINT} SELECT case_id, round((greatest(1.0, l) + 0.05) / (least(1.0, l) + 0.05), 6) AS contrast FROM (SELECT case_id, {LUMINANCE('')} AS l FROM paint WHERE f IS NOT NULL)",
    "nearest_named_color": f"WITH {VALUES}, {PAINT} SELECT case_id, CASE WHEN n.d < 50 THEN n.n END AS name FROM (SELECT case_id, {NEAREST} AS n FROM paint WHERE f IS NOT NULL)",
    "value_kind": f"WITH {VALUES} SELECT case_id, {kind('value')} AS kind FROM vals",
    "normalize_value": rf"WITH {VALUES} SELECT case_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({trim('value')}), '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g'), '\s*\(\s*', '(', 'g'), '\s*\)\s*', ')', 'g') AS normalized FROM vals",
    "clean_value": f"WITH {VALUES} SELECT case_id, {clean('value')} AS cleaned FROM vals",
    "property_gate": f"WITH {VALUES} SELECT case_id, {gate('property')} AS checked FROM vals",
    "allowed_value": f"WITH {VALUES} SELECT case_id, {allowed('value')} AS allowed FROM vals",
    "property_class": f"WITH {VALUES} SELECT case_id, CASE WHEN lower(property) IN {_in(COLOR_PROPERTIES)} THEN 'color' WHEN lower(property) IN {_in(FONT_PROPERTIES)} THEN 'font' WHEN lower(property) IN {_in(SPACING_PROPERTIES)} THEN 'spacing' END AS class FROM vals",
    "definition_name": f"WITH {VALUES} SELECT case_id, nullif(regexp_extract(property, '^\\s*(--[\\w-]+)\\s*$', 1), '') AS name FROM vals",
    "glob_filter": f"WITH {VALUES} SELECT case_id, path, {GLOB('path', EXCLUDED)} AS excluded FROM vals",
    "css_extension": rf"WITH {VALUES} SELECT case_id, lower(regexp_extract(path, '[^/](\.[^./]*)$', 1)) AS extension, lower(regexp_extract(path, '[^/](\.[^./]*)$', 1)) IN ('.css', '.scss', '.sass', '.less') AS is_style FROM vals",
    "relative_path": f"WITH {VALUES} SELECT case_id, CASE WHEN starts_with(path, '/ws') THEN ltrim(substr(path, 4), '/') ELSE path END AS relative FROM vals",
    "offset_to_position": f"WITH {FILES}, s AS (SELECT path, text, CAST(length(text) * 2 // 3 AS INTEGER) AS o FROM sheets) SELECT path, {line('text', 'o')} AS line, {col('text', 'o')} AS col FROM s",
    "position_to_offset": f"WITH {FILES} SELECT path, CAST(least(length(text), coalesce(list_sum(list_transform(string_split(text, chr(10))[1:3], lambda x: length(x) + 1)), 0)) + 5 AS INTEGER) AS \"offset\" FROM sheets",
    "line_text": f"WITH {FILES} SELECT path, coalesce(string_split(text, chr(10))[4], '') AS line FROM sheets",
    "string_hash": f"WITH {VALUES} SELECT case_id, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM (SELECT case_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT)), lambda s, c: (s * 31 + c) % 4294967296) AS h FROM vals)",
    "search_by_name": f"WITH {FILES}, {DEFS}, {INDEX} SELECT name, value FROM idx WHERE contains(lower(name), 'part-1')",
    "search_by_keywords": f"WITH {FILES}, {DEFS}, {INDEX} SELECT name, value FROM idx WHERE contains(lower(name), 'old') OR contains(lower(name), '-19')",
    "variables_by_usage": f"WITH {FILES}, {DEFS}, {INDEX}, m AS ({matched('styles', 'text', VAR, 'path, text', 'u')}), n AS (SELECT regexp_extract(u_m, '{VAR}', 1) AS name, count(*) AS uses FROM m GROUP BY 1) SELECT idx.name, coalesce(uses, 0) AS use_count, CAST(row_number() OVER (ORDER BY coalesce(uses, 0) DESC, path, d_off) AS INTEGER) AS rank FROM idx LEFT JOIN n ON n.name = idx.name",
    "change_replay_index": f"""WITH chg AS ({CHANGES_SQL}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM chg WHERE op <> 'reset') WHERE r = 1 AND seq > coalesce((SELECT max(seq) FROM chg WHERE op = 'reset'), -1)),
 live AS (SELECT path, text FROM last WHERE op = 'upsert'), m AS ({matched('live', 'text', DEFINITION, 'path', 'd')}), d AS (SELECT path, regexp_extract(d_m, '{DEFINITION}', 1) AS name, {clean(f"regexp_extract(d_m, '{DEFINITION}', 2)")} AS value, d_off FROM m)
 SELECT name, value, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, d_off) AS r FROM d) WHERE r = 1""",
    "change_incremental_index": None,
    "parse_errors": f"WITH {FILES} SELECT path, 'Error parseando CSS: Error desconocido' AS message, 0 AS line, 0 AS col FROM files WHERE suffix(path, '7.css')",
    "unreadable_files": f"WITH {FILES} SELECT path, 'Error parseando CSS: Error desconocido' AS message, 0 AS line, 0 AS col, (SELECT count(*) FROM files) AS files_analyzed FROM files WHERE suffix(path, '9.css')",
    "color_info": f"{WITH_RES}, c AS ({with_color('res', 'resolved_value', 'name, resolved_value')}) SELECT name, f AS format, r, g, b, round(a, 6) AS a, CASE WHEN f = 'named' AND a = 0 THEN '#00000000' WHEN f = 'hex' AND length({trim('resolved_value')}) IN (7, 9) THEN lower({trim('resolved_value')}) ELSE {hex_of('r', 'g', 'b', 'a')} END AS hex FROM c WHERE f IS NOT NULL",
    "distinct_paths": f"WITH {FILES} SELECT path, lang, 0 AS pattern_ord, CAST(length(text) AS INTEGER) AS n_chars FROM files",
    "variable_index_all_files": f"WITH {FILES}, {DEFS.replace('tokens', 'styles')}, {INDEX} SELECT name, value, path, line, col, is_color FROM idx",
    "variables_quick_list": f"WITH {FILES}, {DEFS}, {INDEX} SELECT name AS label, value AS description, '📁 ' || regexp_extract(path, '[^/]*$') || ' · Línea ' || (line + 1) AS detail FROM idx",
    "resolution_descriptions": f"{WITH_RES} SELECT r.name, array_to_string(list_filter(['**' || r.name || '**', '', '📄 **Valor:** `' || r.value || '`', CASE WHEN r.resolved_value <> r.value THEN '🔗 **Resuelto:** `' || r.resolved_value || '`' END, CASE WHEN len(r.chain) > 1 THEN '' END, CASE WHEN len(r.chain) > 1 THEN '🔄 **Cadena:** ' || array_to_string(r.chain, ' → ') END, '', '📍 **Archivo:** ' || i.path, '📍 **Línea:** ' || (i.line + 1)], lambda x: x IS NOT NULL), chr(10)) AS description FROM res r JOIN idx i ON i.name = r.name",
    "completion_details": f"{WITH_RES}, {SHADES} SELECT r.name, '**Valor:** `' || r.value || '`' || {GAP} || CASE WHEN r.resolved_value <> r.value THEN '**Resuelto:** `' || r.resolved_value || '`' || {GAP} ELSE '' END || coalesce('**Color:** ' || s.hex || {GAP}, '') || '📁 ' || i.path || ':' || (i.line + 1) AS documentation FROM res r JOIN idx i ON i.name = r.name LEFT JOIN shade s ON s.name = r.name",
    "color_preview": f"WITH {VALUES}, {PAINT}, p AS (SELECT *, CASE WHEN f = 'named' AND a = 0 THEN '#00000000' WHEN f = 'hex' AND length({trim('value')}) IN (7, 9) THEN lower({trim('value')}) ELSE {hex_of('r', 'g', 'b', 'a')} END AS code FROM paint WHERE f IS NOT NULL) SELECT case_id, {preview('code', 'value')} AS markdown FROM p",
    "hover": HOVER,
    "hover_missing": HOVER_MISSING,
    "code_actions": f"{ACTIONS} SELECT * FROM act",
    "autofix_text": f"{ACTIONS}, {FIXED} SELECT path, text, n_fixes FROM fixed",
    "autofix_summary": f"{ACTIONS}, {FIXED}, {AFTER} SELECT CAST((SELECT sum(n_fixes) FROM fixed) AS BIGINT) AS fixes, (SELECT count(*) FROM fixed) AS files, * FROM tot_2",
    "split_compound": SPLIT,
}
_T, _S = CHANGED["tokens"], CHANGED["sheets"]
FILES_AFTER = FILES.replace("tokens AS (", "tokens_1 AS (", 1).replace("sheets AS (", "sheets_1 AS (", 1).replace(
    ", files AS", f", tokens AS (SELECT path, lang, CASE WHEN {_T[0]} THEN {_T[1]} ELSE text END AS text FROM tokens_1 WHERE NOT {DELETED}), sheets AS (SELECT path, lang, CASE WHEN {_S[0]} THEN {_S[1]} ELSE text END AS text FROM sheets_1 WHERE NOT {DELETED}), files AS", 1
)
SQL["change_rediagnose"] = SQL["diagnostics"].replace(FILES, FILES_AFTER)
SQL["change_incremental_index"] = SQL["change_replay_index"]
