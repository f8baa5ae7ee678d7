"""Style corpora derived from the relational test tables, with the same text in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.sources.files import files_from_table

#: Expressions that both SQL dialects read alike; {div} is integer division.
TOKEN_VALUE = """CASE WHEN p_partkey % 89 = 7 THEN 'var(--gone-' || CAST(p_partkey AS STRING) || ')' WHEN p_partkey BETWEEN 30 AND 45 THEN 'var(--part-' || CAST(p_partkey + 1 AS STRING) || ')'
 WHEN p_partkey % 97 = 10 THEN 'var(--part-' || CAST(p_partkey + 1 AS STRING) || ')'
 WHEN p_partkey % 97 = 11 THEN 'var(--part-' || CAST(p_partkey - 1 AS STRING) || ')'
 WHEN p_partkey % 5 = 1 THEN 'var(--part-' || CAST(p_partkey {div} 2 AS STRING) || ')'
 WHEN p_partkey % 5 = 2 THEN CAST(p_size AS STRING) || 'px'
 WHEN p_partkey % 5 = 3 THEN CASE p_partkey % 4 WHEN 0 THEN 'teal' WHEN 1 THEN 'Tomato' WHEN 2 THEN 'rebeccapurple' ELSE 'transparent' END
 ELSE '#' || lpad(lower({hex}), 6, '0') END""".replace("\n", "")
SHEET_RULE = """'.l' || CAST(l_linenumber AS STRING) || ' { ' || CASE l_partkey % 6
 WHEN 0 THEN 'color: var(--part-' || CAST(l_partkey AS STRING) || ');'
 WHEN 1 THEN 'background: var(--part-' || CAST(l_partkey AS STRING) || 'x) no-repeat;'
 WHEN 2 THEN 'color: var(--part-' || CAST(l_partkey AS STRING) || ', #abc); fill: var( --nope , 3px )'
 WHEN 3 THEN 'border-color: #' || lpad(lower({hex}), 6, '0') || ' !important; display: none;'
 WHEN 4 THEN 'font-size:' || CAST(CAST(l_quantity AS INT) AS STRING) || 'px; color: inherit'
 ELSE 'margin: 4px; background-color: Red; top: 0' END || ' }' || {nl}""".replace("\n", "")
#: A rule with a definition and a line that begins with a property.
TOP_RULE = "'.top {' || {nl} || '  --local: 4px;' || {nl} || '  border-color: var(--brand-color, #abc);' || {nl} || '}' || {nl}"
REACT_TEXT = """CASE o_orderkey % 3 WHEN 0 THEN '<a style={{color: ''red'', b: {c: 1}}}/>' || {nl} || '<i style={{x}}/>'
 WHEN 1 THEN '<b className="x"' || {nl} || ' style={s' || CAST(o_orderkey AS STRING) || ' || t}/> <u style = { v }>' ELSE '<p>none</p>' END""".replace("\n", "")
VALUE_TEXT = """CASE k % 16 WHEN 0 THEN '#' || lpad(lower({hex}), 6, '0') WHEN 1 THEN ' #' || lpad(lower({hex}), 3, 'a') || ' ' WHEN 2 THEN '#' || lpad(lower({hex}), 8, '7')
 WHEN 3 THEN 'rgb(' || CAST(k % 300 AS STRING) || ', ' || CAST(k % 256 AS STRING) || ', 7)' WHEN 4 THEN 'rgba(1,' || CAST(k % 256 AS STRING) || ',3, 0.' || CAST(k % 10 AS STRING) || ')'
 WHEN 5 THEN 'RGB(' || CAST(k % 256 AS STRING) || ' 2 3 / ' || CAST(k % 100 AS STRING) || '%)' WHEN 6 THEN 'hsl(' || CAST(k % 400 AS STRING) || ', ' || CAST(k % 101 AS STRING) || '%, 40%)'
 WHEN 7 THEN 'hsla(' || CAST(k % 360 AS STRING) || ', 50%, ' || CAST(k % 101 AS STRING) || '%, .5)' WHEN 8 THEN 'hsl(' || CAST(k % 360 AS STRING) || ' 20% 30%)'
 WHEN 9 THEN CASE k % 3 WHEN 0 THEN 'Tomato' WHEN 1 THEN 'notacolor' ELSE 'transparent' END WHEN 10 THEN CAST(k % 90 AS STRING) || 'px' WHEN 11 THEN '1px  solid ,  #ccc'
 WHEN 12 THEN 'calc( var(--part-' || CAST(k AS STRING) || ' , 3px) + 10PX )' WHEN 13 THEN CAST(k % 50 AS STRING) WHEN 14 THEN 'inherit !important;' ELSE '-' || CAST(k % 9 AS STRING) || '.5REM' END""".replace("\n", "")
PROPERTY_TEXT = "CASE k % 12 WHEN 0 THEN 'color' WHEN 1 THEN 'font-size' WHEN 2 THEN 'background-image' WHEN 3 THEN 'color-scheme' WHEN 4 THEN 'border-color' WHEN 5 THEN 'margin-top' WHEN 6 THEN 'border-top-color' WHEN 7 THEN 'Color' WHEN 8 THEN '--part-' || CAST(k AS STRING) WHEN 9 THEN 'letter-spacing' WHEN 10 THEN 'row-gap' ELSE 'display' END"
PATH_TEXT = "CASE k % 8 WHEN 0 THEN '/ws/a/x.min.css' WHEN 1 THEN '/ws/b/node_modules/y.css' WHEN 2 THEN '/ws/variables.css' WHEN 3 THEN 'variables.css' WHEN 4 THEN '/other/_variables.scss' WHEN 5 THEN '/ws/c/d.LESS' WHEN 6 THEN '/ws/e.tar.tsx' ELSE '/ws/dist/.css' END || CASE WHEN k % 5 = 0 THEN '.map' ELSE '' END"
CURSOR = "event_id AS cursor_id, '/ws/o' || CAST(event_id {div} 3 AS STRING) || '.css' AS path, CAST(1 + event_id % 8 AS INT) AS line, CAST(user_id % 34 AS INT) AS col"
CHANGE = "event_id AS seq, '/ws/u' || CAST(user_id AS STRING) || '.css' AS path, CASE WHEN event_id % 997 = 500 THEN 'reset' WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, ':root{--u-' || CAST(user_id % 50 AS STRING) || ': ' || CAST(event_id % 40 AS STRING) || 'px; --e-' || CAST(event_id AS STRING) || ': red;}' AS text"

_SPARK = {"div": "div", "nl": "'\\n'"}
_DUCK = {"div": "//", "nl": "chr(10)"}


def _filled(text: str, words: dict[str, str]) -> str:
    for name, word in words.items():
        text = text.replace("{" + name + "}", word)
    return text


def _spark(text: str, number: str = "0") -> str:
    return _filled(text, _SPARK | {"hex": f"hex({number})"})


def _duck(text: str, number: str = "0") -> str:
    return _filled(text, _DUCK | {"hex": f"to_hex({number})"}).replace("AS STRING)", "AS VARCHAR)")


TOKEN_NUMBER, SHEET_NUMBER, VALUE_NUMBER = "p_partkey * 7919 % 16777216", "l_partkey * 104729 % 16777216", "k * 7919 % 4096"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Texts of a key in order, as one."""
    item = f"struct({', '.join(order)}, part)"
    return df.groupBy(key).agg(_expr(f"array_join(transform(array_sort(collect_list({item})), x -> x.part), '')").alias("body"))


def _expr(text: str):
    from pyspark.sql import functions as F

    return F.expr(text)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variables file for each brand."""
    part = _table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", f"'--part-' || CAST(p_partkey AS STRING) || ': ' || {_spark(TOKEN_VALUE, TOKEN_NUMBER)} || '; ' AS part")
    return _joined(part, "p_brand", ["p_partkey"]).selectExpr("'/ws/' || p_brand || '/variables.css' AS path", "'/* --old: 1px; */ :root{--brand-color: teal; ' || body || '}' AS text")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style sheet for each order."""
    line = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_spark(SHEET_RULE, SHEET_NUMBER)} AS part")
    return _joined(line, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).selectExpr("'/ws/o' || CAST(l_orderkey AS STRING) || '.css' AS path", f"'/* {{order}} */\\n@media all {{\\n' || {_spark(TOP_RULE)} || body || '}}' AS text")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for each order."""
    return _table(spark, sf_dir, "orders").selectExpr("'/ws/r' || CAST(o_orderkey AS STRING) || '.tsx' AS path", f"{_spark(REACT_TEXT)} AS text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # languages as constants, so that a query of one language reads only what makes it
    known = lambda df, lang: df.selectExpr("path", f"'{lang}' AS lang", "text")
    every = known(tokens(spark, sf_dir).unionByName(sheets(spark, sf_dir)), "css").unionByName(known(components(spark, sf_dir), "typescriptreact"))
    return files_from_table(every)


#: A change of the corpus: some variables files rename a third of their names, some sheets call another variable, some go.
CHANGED = {"tokens": ("path LIKE '%1/variables.css'", "replace(text, '--part-1', '--moved-1')"), "sheets": ("path LIKE '%3.css'", "replace(text, '--nope', '--brand-color')")}
DELETED = "path LIKE '%77.css'"


def changed_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents after the change, and the paths that it wrote or deleted."""
    every = files(spark, sf_dir)
    (tokens_hit, tokens_text), (sheets_hit, sheets_text) = CHANGED["tokens"], CHANGED["sheets"]
    text = f"CASE WHEN {tokens_hit} THEN {tokens_text} WHEN {sheets_hit} THEN {sheets_text} ELSE text END"
    after = every.where(f"NOT {DELETED}").selectExpr("path", "lang", f"{text} AS text", "pattern_ord")
    return after, every.where(f"{tokens_hit} OR {sheets_hit} OR {DELETED}").select("path")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, value, property, path: varied inputs of the scalar functions."""
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS k").selectExpr("k AS case_id", f"{_spark(VALUE_TEXT, VALUE_NUMBER)} AS value", f"{_spark(PROPERTY_TEXT)} AS property", f"{_spark(PATH_TEXT)} AS path")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_split(_spark(CURSOR)))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_split(_spark(CHANGE)))


def _split(columns: str) -> list[str]:
    """Select items at commas outside brackets and quotes."""
    out, depth, quoted, part = [], 0, False, ""
    for ch in columns:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


TOKENS_SQL = f"""SELECT '/ws/' || p_brand || '/variables.css' AS path, 'css' AS lang, '/* --old: 1px; */ :root{{--brand-color: teal; ' || string_agg('--part-' || CAST(p_partkey AS VARCHAR) || ': ' || {_duck(TOKEN_VALUE, TOKEN_NUMBER)} || '; ', '' ORDER BY p_partkey) || '}}' AS text FROM part GROUP BY p_brand"""
SHEETS_SQL = f"""SELECT '/ws/o' || CAST(l_orderkey AS VARCHAR) || '.css' AS path, 'css' AS lang, '/* {{order}} */' || chr(10) || '@media all {{' || chr(10) || {_duck(TOP_RULE)} || string_agg({_duck(SHEET_RULE, SHEET_NUMBER)}, '' ORDER BY l_linenumber, l_partkey, l_suppkey) || '}}' AS text FROM lineitem GROUP BY l_orderkey"""
COMPONENTS_SQL = f"""SELECT '/ws/r' || CAST(o_orderkey AS VARCHAR) || '.tsx' AS path, 'typescriptreact' AS lang, {_duck(REACT_TEXT)} AS text FROM orders"""
VALUES_SQL = f"""SELECT k AS case_id, {_duck(VALUE_TEXT, VALUE_NUMBER)} AS value, {_duck(PROPERTY_TEXT)} AS property, {_duck(PATH_TEXT)} AS path FROM (SELECT p_partkey AS k FROM part)"""
CURSORS_SQL = f"SELECT {_duck(CURSOR)} FROM events"
CHANGES_SQL = f"SELECT {_duck(CHANGE)} FROM events"
