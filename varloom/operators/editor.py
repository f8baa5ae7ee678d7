"""Editor point queries as batches over cursors(cursor_id, path, line, col)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.config import COLOR_HINTS, COMPLETION_LANGUAGES, COMPLETIONS_BEFORE_VAR, COMPLETIONS_IN_VAR, HOVER_LANGUAGES, SIMILAR, AnalyzerConfig
from varloom.functions.color import parse_color, preview_markdown
from varloom.functions.globs import relative_path
from varloom.functions.text import WS, line_text, matches
from varloom.functions.values import VAR
from varloom.sources.shared import written

_S = f"[{WS}]"
DEFINED = rf"(--[\w-]+){_S}*:"
CALL = rf"var\({_S}*(--[\w-]+)"


def cursor_lines(cursors: DataFrame, files: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Cursors with the text of their line; documents of other languages answer nothing."""
    known = files if languages is None else files.where(F.col("lang").isin(*languages))
    return cursors.join(known.select("path", "text"), "path").withColumn("text", line_text(F.col("text"), F.col("line"))).withColumnRenamed("text", "line_text")


def _at(found: Column, end: Column | None = None) -> Column:
    """First match whose inclusive span holds the cursor's column."""
    return F.get(F.filter(found, lambda m: (F.col("col") >= m["offset"]) & (F.col("col") <= m["offset"] + F.length(m["match"]))), F.lit(0))


def variable_at_cursor(lines: DataFrame) -> DataFrame:
    """cursor_id, name, start_col, end_col: the var() call under the cursor, else the definition whose name is."""
    call = _at(matches(F.col("line_text"), VAR))
    named = F.transform(matches(F.col("line_text"), DEFINED), lambda m: F.struct(m["offset"].alias("offset"), F.regexp_extract(m["match"], DEFINED, 1).alias("match")))
    defined = _at(named)
    c = lines.withColumn("call", call).withColumn("defined", defined)
    name = F.coalesce(F.regexp_extract("call.match", VAR, 1), F.col("defined.match"))
    at = F.when(F.col("call").isNotNull(), F.call_function("locate", name, F.col("line_text"), F.col("call.offset") + 1) - 1).otherwise(F.col("defined.offset"))
    return c.withColumn("name", name).where("name is not null").select("cursor_id", "path", "line", "name", at.alias("start_col"), (at + F.length("name")).alias("end_col"))


def property_at(line: Column, col: Column) -> Column:
    """Property of a cursor behind the first colon of its line, or null."""
    name = F.regexp_extract(line, rf"^{_S}*([a-zA-Z-]+){_S}*:{_S}*", 1)
    return F.when((name != "") & (col > F.call_function("instr", line, F.lit(":")) - 1), name)


def property_at_cursor(lines: DataFrame) -> DataFrame:
    return lines.select("cursor_id", property_at(F.col("line_text"), F.col("col")).alias("property")).where("property is not null")


def goto_definition(lines: DataFrame, index: DataFrame) -> DataFrame:
    """cursor_id, name and the place of its definition; null places where the index lacks it. Definitions under the cursor do not count."""
    call = _at(matches(F.col("line_text"), CALL))
    c = lines.select("cursor_id", F.regexp_extract(call["match"], CALL, 1).alias("name")).where("name is not null and name <> ''")
    return c.join(index.select("name", F.col("path").alias("target_path"), F.col("line").alias("target_line"), F.col("col").alias("target_col")), "name", "left").select("cursor_id", "name", "target_path", "target_line", "target_col")


def inside_var(before: Column) -> Column:
    """Whether the last var( before the cursor is still open."""
    rest = F.substring_index(before, "var(", -1)
    # closed as soon as the closing brackets outnumber the opening ones
    depth = F.aggregate(F.split(rest, ""), F.struct(F.lit(1).alias("d"), F.lit(True).alias("open")), lambda s, ch: F.struct((s["d"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("d"), (s["open"] & (s["d"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0) > 0)).alias("open")))
    return F.contains(before, F.lit("var(")) & depth["open"]


def can_suggest(before: Column) -> Column:
    """Whether the cursor stands behind a colon and at most the beginning of a word."""
    return before.rlike(rf":{_S}*[\w-]*\z")


def filter_text(before: Column) -> Column:
    """What has been written of a name inside var(, without its hyphens in front."""
    return F.regexp_replace(F.regexp_extract(before, r"var\((-*[\w-]*)\z", 1), "^-+", "")


def completion_contexts(lines: DataFrame) -> DataFrame:
    """cursor_id, mode (name, call), property, filter of the cursors at which completion answers."""
    before = F.substring("line_text", F.lit(1), F.col("col"))
    inside = inside_var(before) | before.rlike(r"var\((--[\w-]*)?\z")
    mode = F.when(inside, "name").when(can_suggest(before), "call")
    return lines.select("cursor_id", mode.alias("mode"), property_at(F.col("line_text"), F.col("col")).alias("property"), F.when(inside, filter_text(before)).otherwise("").alias("filter")).where("mode is not null")


#: Letters that a filter and a name meet by first, letters of a filter that are looked up whole, and shares of the cursors that one short filter meets.
GRAM, HEAD, SHARES = 3, 64, 16


def _grams(text: str) -> Column:
    """Every distinct part of a text of one to GRAM letters."""
    t = F.col(text)

    def of(k: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k)))
        return F.when(F.length(t) >= k, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def _begun(text: Column, gram: Column, sizes: Column) -> Column:
    """Every distinct part of a text that begins with a gram and has one of the sizes."""
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.length(gram)) == gram)
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= F.length(text)), lambda k: F.substring(text, i, k)))))


def completions(contexts: DataFrame, index: DataFrame, resolved: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """cursor_id, rank, label, insert_text, detail, relevance, tags, sort_text, is_color_item of each completion.

    Ranking is made once for each distinct context of a filter, a property's
    words and whether it takes colours, not for each cursor. A name meets a
    filter by equality with one of its own parts, of which only those are made
    that begin like a filter and are as long as one that begins so; an empty
    filter is a part of every name. Names that hold the same keywords and agree
    in being colours stand in one order in every context, so of each such class
    only the first ones of a part meet its contexts, and of each task only these
    are shuffled. Filters over HEAD letters meet the names that hold their
    beginning. The contexts are written once, since ranking and cursors ask for them.
    """
    order, most = ["pattern_ord", "path", "offset"], max(COMPLETIONS_IN_VAR, COMPLETIONS_BEFORE_VAR)
    contexts = written(contexts, "contexts")
    words = F.create_map(*[x for k, v in config.keywords.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]) if config.keywords else F.lit(None).cast("map<string,array<string>>")
    asked = contexts.withColumn("words", F.coalesce(F.element_at(words, F.col("property")), F.array().cast("array<string>")))
    asked = asked.withColumn("wants_color", F.coalesce(F.exists(F.array(*[F.lit(p) for p in COLOR_HINTS]), lambda p: F.contains("property", p)), F.lit(False)))
    asked = asked.withColumn("part", F.lower("filter"))
    distinct = asked.select("words", "wants_color", "part").distinct().withColumn("head", F.substring("part", 1, HEAD))
    # a row for each beginning of a filter: letters make a bounded number of them, with at most HEAD sizes each
    starts = distinct.groupBy(F.substring("head", 1, GRAM).alias("gram")).agg(F.collect_set(F.length("head")).alias("sizes"))
    every = sorted({w.lower() for v in config.keywords.values() for w in v})
    held = F.filter(F.array(*[F.lit(w) for w in every]).cast("array<string>"), lambda w: F.contains("lower", w))
    known = index.withColumn("lower", F.lower("name")).withColumn("held", held)
    # an inner explode would get a filter on its size, which makes the array twice
    known = known.withColumn("gram", F.explode_outer(F.concat(F.array(F.lit("")), _grams("lower")))).join(F.broadcast(starts), "gram")
    known = known.withColumn("head", F.explode_outer(_begun(F.col("lower"), F.col("gram"), F.col("sizes")))).where("head is not null").drop("gram", "sizes")
    # names that may not hold the rest of a longer filter stay apart
    known = known.withColumn("apart", F.when(F.length("head") >= HEAD, F.col("name")))
    first = F.row_number().over(Window.partitionBy("head", "held", "is_color", "apart").orderBy(F.desc("use_count"), *order))
    met = known.withColumn("at", first).where(F.col("at") <= most).drop("at", "held", "apart").join(distinct, "head").where(F.contains("lower", F.col("part")))
    met = met.withColumn("tags", F.filter("words", lambda w: F.contains("lower", F.lower(w))))
    score = F.col("use_count") + 50 * F.size("tags") + F.when(F.col("part") != "", 30).otherwise(0) + F.when(F.col("wants_color") & F.col("is_color"), 40).otherwise(0)
    met = met.withColumn("relevance", score)
    rank = F.row_number().over(Window.partitionBy("words", "wants_color", "part").orderBy(F.desc("relevance"), *order))
    top = met.withColumn("rank", rank).where(F.col("rank") <= most)
    top = top.join(resolved.select("name", F.coalesce(F.nullif("resolved_value", F.lit("")), F.col("value")).alias("shown")), "name")
    top = top.select("words", "wants_color", "part", "rank", "name", "value", "shown", "relevance", "tags", parse_color(F.col("shown")).alias("color"))
    # the cursors of a short filter, above all of the empty one, are dealt over shares
    short = F.length("part") <= GRAM
    top = top.withColumn("share", F.explode(F.sequence(F.lit(0), F.when(short, SHARES - 1).otherwise(0))))
    asked = asked.withColumn("share", F.when(short, F.pmod(F.xxhash64("cursor_id"), F.lit(SHARES)).cast("int")).otherwise(0))
    limit = F.when(F.col("mode") == "name", COMPLETIONS_IN_VAR).otherwise(COMPLETIONS_BEFORE_VAR)
    found = asked.join(top, ["words", "wants_color", "part", "share"]).where(F.col("rank") <= limit)
    call = F.concat(F.lit("var("), "name", F.lit(")"))
    detail = F.when(F.col("mode") == "call", F.col("value")).otherwise(F.coalesce(F.col("color.hex"), F.col("shown")))
    text = F.when(F.col("mode") == "call", call).otherwise(F.col("name"))
    return found.select(*contexts.columns, "rank", "name", text.alias("label"), text.alias("insert_text"), detail.alias("detail"), "relevance", "tags", F.lpad((F.col("rank") - 1).cast("string"), 4, "0").alias("sort_text"), F.col("color").isNotNull().alias("is_color_item"))


def completion_details(index: DataFrame, resolved: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """name and the Markdown shown beside a selected completion."""
    r = resolved.where("found").join(index.select("name", "path", "line"), "name")
    final = F.coalesce(F.nullif("resolved_value", F.lit("")), F.col("value"))
    parts = [
        F.concat(F.lit("**Valor:** `"), "value", F.lit("`\n\n")), F.when(F.col("resolved_value") != F.col("value"), F.concat(F.lit("**Resuelto:** `"), "resolved_value", F.lit("`\n\n"))),
        F.concat(F.lit("**Color:** "), parse_color(final)["hex"], F.lit("\n\n")), F.concat(F.lit("\U0001f4c1 "), relative_path(F.col("path"), config.roots), F.lit(":"), F.col("line") + 1),
    ]
    return r.select("name", F.concat_ws("", *parts).alias("documentation"))


#: Words up to this length meet by all their parts, of which there are as many as the length's square; longer ones by their grams.
SHORT = 24


def _parts(text: str, least: int) -> Column:
    """Every distinct part of a text of least letters or more."""
    t = F.col(text)
    inside = F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(F.sequence(F.lit(1), F.length(t) - i + 1), lambda k: F.substring(t, i, k))))
    found = F.when(F.length(t) > 0, inside).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(F.lit("")), found), lambda p: F.length(p) >= least))


def _contained(inner: DataFrame, outer: DataFrame, i: str, o: str) -> DataFrame:
    """Pairs of words of which i stands within o: o's parts are i, or, where o is long, one of its grams begins i and o holds the rest."""
    short = outer.where(F.length(o) <= SHORT)
    exact = short.withColumn(i, F.explode(_parts(o, 0))).join(inner, i).select(i, o)
    long = outer.where(F.length(o) > SHORT).withColumn("gram", F.explode(F.concat(F.array(F.lit("")), _grams(o))))
    begun = inner.withColumn("gram", F.substring(i, 1, GRAM)).join(long, "gram").where(F.contains(o, F.col(i))).select(i, o)
    return exact.unionByName(begun)


#: A word of more names than this is frequent: names do not meet by it one by one.
FREQUENT = 256


def _shared(pairs: DataFrame, theirs: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """name, candidate, points of all pairs that a rare word makes, and of those by frequent words that can be among the best.

    Candidates of the same frequent words and first letters have the same points
    for a name but for their rare words: of each such class the first ones in
    index order have no fewer than any other that no rare word finds.
    """
    often = theirs.groupBy("v").agg(F.count("*").alias("__c")).where(F.col("__c") > FREQUENT).select("v")
    common, rare = theirs.join(often, "v", "left_semi"), theirs.join(often, "v", "left_anti")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "m"))), lambda x: F.concat(x["v"], F.lit("-"), x["m"])), "-")
    classed = common.groupBy("candidate").agg(words.alias("class")).join(known, "candidate").withColumn("start", F.substring("lower", 1, 5))
    first = F.row_number().over(Window.partitionBy("class", "start").orderBy("pattern_ord", "path", "offset"))
    heads = classed.withColumn("at", first).where(F.col("at") <= limit).select("candidate")
    by_rare = pairs.join(rare, "v").select("name", "candidate", (F.col("n") * F.col("m")).alias("p"))
    by_common = pairs.join(common.join(heads, "candidate", "left_semi"), "v").select("name", "candidate")
    met = by_rare.select("name", "candidate").unionByName(by_common).distinct()
    # what frequent words add, by the few that a candidate has
    added = met.join(common, "candidate").join(pairs, ["name", "v"]).select("name", "candidate", (F.col("n") * F.col("m")).alias("p"))
    return by_rare.unionByName(added).groupBy("name", "candidate").agg((10 * F.sum("p")).cast("int").alias("points"))


def hover_similar(names: DataFrame, index: DataFrame, limit: int = SIMILAR) -> DataFrame:
    """name, rank, candidate, points: names that share words with a missing one.

    10 for each pair of a word of two letters or more and a candidate's word,
    either within the other; 5 where the first five characters agree. Distinct
    words meet by equality with the parts of each other, and names through
    their words; of the names that agree at the beginning only, the first in
    index order can be among the best, so no more of them are looked at. The
    distinct names are written once, since five steps ask for them and they may
    come from a parse of all documents.
    """
    order = ["pattern_ord", "path", "offset"]
    words = lambda c: F.split(F.call_function("regexp_replace", F.lower(c), F.lit("^(.*?)--"), F.lit("$1")), "-", -1)
    asked = written(names.select("name").distinct(), "asked").withColumn("start", F.substring(F.lower("name"), 1, 5))
    known = index.select(F.col("name").alias("candidate"), F.lower("name").alias("lower"), *order)
    mine = asked.select("name", F.explode(words(F.col("name"))).alias("w")).where(F.length("w") >= 2).groupBy("name", "w").agg(F.count("*").alias("n"))
    theirs = known.select("candidate", F.explode(words(F.col("candidate"))).alias("v")).groupBy("candidate", "v").agg(F.count("*").alias("m"))
    w, v = mine.select("w").distinct(), theirs.select("v").distinct()
    within, around = _contained(w, v, "w", "v").select("w", "v"), _contained(v, w, "v", "w").select("w", "v")
    pairs = mine.join(within.unionByName(around).distinct(), "w").groupBy("name", "v").agg(F.sum("n").alias("n"))
    shared = _shared(pairs, theirs, known, limit)
    shared = shared.join(asked, "name").join(known, "candidate").withColumn("points", F.col("points") + F.when(F.startswith("lower", F.col("start")), 5).otherwise(0))
    starts = known.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.substring("lower", F.lit(1), k)))).distinct()
    first = F.row_number().over(Window.partitionBy("start").orderBy(*order))
    starts = starts.withColumn("at", first).where(F.col("at") <= limit).join(asked, "start").join(shared.select("name", "candidate"), ["name", "candidate"], "left_anti")
    met = shared.unionByName(starts.withColumn("points", F.lit(5)).drop("at"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("points"), *order))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("name", "rank", "candidate", "points")


def hover(cursors: DataFrame, files: DataFrame, index: DataFrame, resolved: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """cursor_id, name, range and Markdown of the variable under each cursor; null where the index lacks it, see hover_missing."""
    at = variable_at_cursor(cursor_lines(cursors, files, HOVER_LANGUAGES)).withColumnRenamed("path", "doc").withColumnRenamed("line", "doc_line")
    r = resolved.join(index.select("name", "path", "line", "use_count"), "name")
    final = F.coalesce(F.nullif("resolved_value", F.lit("")), F.col("value"))
    differs = F.col("resolved_value") != F.col("value")
    parts = [
        F.concat(F.lit("### `"), "name", F.lit("`\n\n")), F.concat(preview_markdown(parse_color(final)), F.lit("\n\n---\n\n")), F.concat(F.lit("**Valor:** `"), "value", F.lit("`\n\n")),
        F.when(differs, F.concat(F.lit("**Valor Resuelto:** `"), "resolved_value", F.lit("`\n\n"))),
        F.when(differs & (F.size("chain") > 1), F.concat(F.lit("**Cadena:** "), F.array_join(F.transform("chain", lambda n: F.concat(F.lit("`"), n, F.lit("`"))), " → "), F.lit("\n\n"))),
        F.concat(F.lit("---\n\n\U0001f4c1 **Definido en:** ["), relative_path(F.col("path"), config.roots), F.lit(":"), F.col("line") + 1, F.lit("](file://"), "path", F.lit("#L"), F.col("line") + 1, F.lit(")\n\n")),
        F.when(F.col("use_count") > 0, F.concat(F.lit("\U0001f4ca **Usos detectados:** "), "use_count", F.lit("\n"))),
    ]
    shown = r.select("name", F.concat_ws("", *parts).alias("markdown"))
    return at.join(shown, "name", "left").select("cursor_id", "name", "doc_line", "start_col", "end_col", "markdown")


def hover_missing(names: DataFrame, index: DataFrame) -> DataFrame:
    """name and the Markdown for a name that the index lacks, with similar names."""
    found = hover_similar(names, index).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("similar"))
    head = F.concat(F.lit("### ⚠️ Variable No Encontrada\n\nLa variable `"), "name", F.lit("` no está definida en ninguno de los archivos de variables configurados.\n\n"))
    tail = F.concat(F.lit("**¿Quisiste decir?**\n"), F.array_join(F.transform("similar", lambda s: F.concat(F.lit("- `"), s["candidate"], F.lit("`\n"))), ""))
    return names.select("name").distinct().join(found, "name", "left").select("name", F.concat(head, F.coalesce(tail, F.lit(""))).alias("markdown"))


COMPLETION = COMPLETION_LANGUAGES
