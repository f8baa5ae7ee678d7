"""Ranked suggestions: similar names, variables for a value, code actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.config import HARDCODED, SIMILAR, SUGGESTIONS, UNDEFINED
from varloom.functions.color import is_color, parse_color
from varloom.functions.text import WS, js_trim, line_text
from varloom.sources.shared import written

ORDER = ["pattern_ord", "c_path", "offset"]


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def _without(names: DataFrame, text: str, keep: list[str], letters: int) -> DataFrame:
    """keep, part: the hash of each text with up to this many of its characters left out, in every way, some more than once.

    Places become rows first, so that generated code cuts the texts; keep has the text.
    """
    i, j, t = F.col("__i"), F.col("__j"), F.col(text)
    # names are short and their parts many, so a small file's names are dealt out before
    rows = names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(*keep, F.explode_outer(F.sequence(F.lit(0), F.length(t))).alias("__i"))
    # nothing is left out at 0, one character where both places are the same
    rows = rows.select("*", F.explode_outer(F.sequence(i, F.when(i == 0, 0).otherwise(F.length(t) if letters > 1 else i))).alias("__j"))
    part = F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, j - i - 1), F.substring(t, j + 1, F.length(t)))
    return rows.select(*keep, F.xxhash64(part).alias("part"))


#: Names up to this length meet by what is left when letters go, of which there are as many as the length's square; longer ones by segments.
SHORT = 40


def _segment(length: Column, k: Column, parts: int) -> tuple[Column, Column]:
    """Start, from 0, and size of segment k when a length is cut into parts as even as can be."""
    base, longer = F.floor(length / parts), parts - F.pmod(length, F.lit(parts))
    return (k * base + F.greatest(F.lit(0), k - longer)).cast("int"), (base + F.when(k >= longer, 1).otherwise(0)).cast("int")


def _within_long(wanted: DataFrame, known: DataFrame, letters: int) -> DataFrame:
    """Pairs of long names at an edit distance of at most letters.

    Of one segment more than there are edits one stays whole, and stands in the
    other name at most that many letters aside; so a name has some dozens of
    segments to meet by, each shorter than itself.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(letters))).alias("k")
    right = known.where(F.length("candidate") > SHORT - letters).select("candidate", F.length("candidate").alias("len"), parts)
    start, size = _segment(F.col("len"), F.col("k"), letters + 1)
    right = right.select("candidate", "len", "k", F.substring("candidate", start + 1, size).alias("part"))
    aside = F.sequence(F.lit(-letters), F.lit(letters))
    left = wanted.where(F.col("n") > SHORT).select("var_name", "n", F.explode(F.transform(aside, lambda x: F.col("n") + x)).alias("len"), F.explode(aside).alias("shift")).select("*", parts)
    start, size = _segment(F.col("len"), F.col("k"), letters + 1)
    left = left.select("*", (start + F.col("shift")).alias("at"), size.alias("size")).where("at >= 0 and at + size <= n")
    left = left.select("var_name", "n", "len", "k", F.substring("var_name", F.col("at") + 1, F.col("size")).alias("part")).distinct()
    return left.join(right.hint("merge"), ["len", "k", "part"]).select("var_name", "n", "candidate").distinct()


def _within(wanted: DataFrame, known: DataFrame, letters: int) -> DataFrame:
    """Pairs of names at an edit distance of at most letters: both leave the same text when that many letters go, or share a segment.

    Parts are many times as large as the names they are made of, which sizes
    known before a run don't show: the hints keep them from being broadcast.
    """
    near = F.expr(f"levenshtein(candidate, var_name, {letters})")
    left = _without(wanted.where(F.col("n") <= SHORT), "var_name", ["var_name", "n"], letters)
    right = _without(known.where(F.length("candidate") <= SHORT + letters), "candidate", ["candidate"], letters)
    met = left.join(right.hint("merge"), "part").select("var_name", "n", "candidate").withColumn("lev", near).where("lev >= 0").distinct()
    return met.unionByName(_within_long(wanted, known, letters).withColumn("lev", near).where("lev >= 0"))


def _best(pairs: DataFrame, limit: int) -> DataFrame:
    """var_name, n, best: the most similar candidates of each name above one half, in order, as one row."""
    longer = F.greatest("n", F.length("candidate"))
    near = pairs.withColumn("similarity", (longer - F.col("lev")) / longer).where("similarity > 0.5")
    rank = F.row_number().over(Window.partitionBy("var_name").orderBy(F.desc("similarity"), *ORDER))
    item = F.struct("rank", "candidate", "similarity")
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy("var_name", "n").agg(F.array_sort(F.collect_list(item)).alias("best"))


#: Similarities down to which classes of names meet, one after the other; the last is the least that counts.
LEAST = (0.58, 0.5)


def _letters(text: Column) -> Column:
    """A long with a bit for each character of a text and how many equal ones stand before it, several to a bit.

    A bit that another text lacks stands for a character that it lacks, so bits
    that one of two has alone are at most as many as the edits between them.
    """

    def bit(c: Column, i: Column) -> Column:
        before = F.substring(text, F.lit(1), i)
        equal = F.length(before) - F.length(F.replace(before, c, F.lit("")))
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, equal), F.lit(64)).cast("int"))

    return F.aggregate(F.transform(F.split(text, ""), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _classes_within(wanted: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs of names above one half, all that have at least this similarity among them.

    Distinct lengths and bits of letters meet, at lengths that the index has and
    over sixteen shares of it; only names of classes whose bound is high enough
    are compared.
    """
    # only lengths that the index has: one row, as wide as its longest name at most
    lengths = known.agg(F.collect_set("len").alias("lengths"))
    asked = wanted.select("n", "bits").distinct().join(F.broadcast(lengths)).withColumn("len", F.explode(F.filter("lengths", lambda x: (2 * x > F.col("n")) & (x < 2 * F.col("n"))))).drop("lengths")
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    classes = known.select("len", "k_bits").distinct().withColumn("share", F.pmod(F.xxhash64("k_bits"), F.lit(16)))
    alone = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    longer, edits = F.greatest("n", "len"), F.greatest(alone("bits", "k_bits"), alone("k_bits", "bits"), F.abs(F.col("n") - F.col("len")))
    met = asked.join(classes.hint("merge"), ["len", "share"]).where((longer - edits) / longer >= least).select("n", "bits", "len", "k_bits")
    pairs = wanted.join(met.hint("merge"), ["n", "bits"]).select("var_name", "n", "len", "k_bits").join(known.hint("merge"), ["len", "k_bits"])
    return pairs.withColumn("lev", F.expr("levenshtein(candidate, var_name, (greatest(n, len) - 1) div 2)")).where("lev >= 0")


def similar_names(names: DataFrame, index: DataFrame, limit: int = SIMILAR) -> DataFrame:
    """var_name, rank, candidate, similarity: the most similar indexed names of each distinct name, above one half.

    Names at a distance of one, then two, meet by equality on what both leave
    when letters are left out, long names on segments. A name longer than d * (d + 1) with enough
    candidates within distance d is done: all others are less similar. What is
    left meets by classes of equal length and letters, from similar ones on: a
    name with enough candidates as similar as the classes met so far can be is
    done. Ties follow index order. Names, the index's names and the best of each
    step are written once, since later steps ask for them and they may come from
    a parse of all documents.
    """
    wanted = written(names.select(F.col("name").alias("var_name")).distinct(), "wanted").withColumn("n", F.length("var_name")).where("n > 0")
    known = written(index.select(F.col("name").alias("candidate"), "pattern_ord", F.col("path").alias("c_path"), "offset"), "candidates")
    found = []
    for letters in (1, 2):
        best = written(_best(_within(wanted, known.select("candidate"), letters).join(known, "candidate"), limit), "best")
        done = best.where((F.col("n") > letters * (letters + 1)) & (F.size("best") >= limit))
        found.append(done)
        wanted = wanted.join(done.select("var_name"), "var_name", "left_anti")
    wanted = written(wanted.withColumn("bits", _letters(F.col("var_name"))), "far")
    known = written(known.withColumn("len", F.length("candidate")).withColumn("k_bits", _letters(F.col("candidate"))), "classes")
    for least in LEAST:
        best = written(_best(_classes_within(wanted, known, least), limit), "best")
        done = best.where((F.size("best") >= limit) & (F.get("best", F.lit(limit - 1))["similarity"] >= least)) if least > LEAST[-1] else best
        found.append(done)
        wanted = wanted.join(done.select("var_name"), "var_name", "left_anti")
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("var_name", F.explode("best").alias("b")).select("var_name", "b.rank", "b.candidate", "b.similarity")


CUBE = ["r", "g", "b"]
#: Widths of the cells of the colour cube in which enough variables are looked for, from near to far.
WIDTHS = (2, 4, 8, 16, 32, 64)
#: Distances within which colours meet.
REACHES = (2, 4, 7, 14, 28, 56, 111)
FAR = 200  # from this distance on no score is above 10


def _cells(df: DataFrame, width: Column, around: bool = False, at: str = "") -> DataFrame:
    """Adds r_cell, g_cell and b_cell of each colour, by its columns with the ending at; around gives a row for each neighbouring cell too."""
    for c in CUBE:
        cell = F.floor(F.col(c + at) / width)
        df = df.withColumn(f"{c}_cell", F.explode(F.array(cell - 1, cell, cell + 1)) if around else cell)
    return df


def _nearest(asked: DataFrame, colors: DataFrame, order: list, limit: int) -> DataFrame:
    """r, g, b and hits: the limit nearest variables of each asked colour, closer than FAR, in order.

    Of the least cell around an asked colour that holds enough variables, the
    last of the first ones tells how far the nearest can be: colours meet by
    equality on cells as wide as the least of REACHES from there on, and their
    neighbours, or on cells as wide as FAR where no cell holds enough. An asked
    colour outside the box of all variables' colours, such as rgb(290, 0, 0),
    meets from the nearest point of the box: the square of its distance to any
    variable is at least that to this point and that from there together.
    """
    cell = [f"{c}_cell" for c in CUBE]
    widths = F.explode(F.array(*[F.lit(w) for w in WIDTHS])).alias("width")
    square = sum(((F.col(c) - F.col(f"{c}_k")) * (F.col(c) - F.col(f"{c}_k")) for c in CUBE), F.lit(0))

    def named(df: DataFrame) -> DataFrame:
        for c in CUBE:
            df = df.withColumnRenamed(c, f"{c}_k")
        return df

    placed = _cells(colors.select(*CUBE, widths), F.col("width"))
    crowd = placed.groupBy("width", *cell).agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    at = [f"{c}_at" for c in CUBE]
    box = colors.agg(*[f(c).alias(f"{c}_{k}") for c in CUBE for k, f in (("lo", F.min), ("hi", F.max))])
    # one row, so the join is with a constant
    boxed = asked.join(F.broadcast(box)).select(*CUBE, *[F.least(F.greatest(c, f"{c}_lo"), f"{c}_hi").alias(f"{c}_at") for c in CUBE])
    out = sum(((F.col(c) - F.col(f"{c}_at")) * (F.col(c) - F.col(f"{c}_at")) for c in CUBE), F.lit(0))
    enough = _cells(boxed.select("*", widths), F.col("width"), at="_at").join(crowd, ["width", *cell], "left").groupBy(*CUBE, *at).agg(F.min(F.when(F.col("n").isNotNull(), F.col("width"))).alias("width"))
    own = _cells(enough.where("width is not null"), F.col("width"), at="_at").join(named(placed), ["width", *cell]).withColumn("square", square)
    last = own.withColumn("k", F.row_number().over(Window.partitionBy(*CUBE).orderBy("square"))).where(F.col("k") == limit).select(*CUBE, (F.col("square") - out).alias("bound"))
    far = F.lit(FAR)
    for r in reversed(REACHES):
        far = F.when(F.col("bound") <= r * r, r).otherwise(far)
    around = _cells(enough.join(last, CUBE, "left").select(*CUBE, *at, far.alias("reach")), F.col("reach"), around=True, at="_at")
    every = F.explode(F.array(*[F.lit(r) for r in (*REACHES, FAR)])).alias("reach")
    known = named(_cells(colors.select("*", every), F.col("reach")))
    met = around.join(known, ["reach", *cell]).withColumn("square", square).where((F.col("square") - out <= F.col("reach") * F.col("reach")) & (F.col("square") < FAR * FAR))
    rank = F.row_number().over(Window.partitionBy(*CUBE).orderBy("square", *order))
    item = F.struct("rank", "square", "candidate", "key", "use_count", *ORDER)
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy(*CUBE).agg(F.array_sort(F.collect_list(item)).alias("hits"))


def variables_for_values(values: DataFrame, index: DataFrame, resolved: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """value, rank, candidate, score: variables that stand for each distinct value.

    100 for the same text as the resolved value without regard to case; for two
    colours 50 less a fifth of their distance, if above 10. The exact branch is
    an equi-join. In the colour branch distinct colours of both sides meet, each
    with its first variables: limit for each text, twice that for each colour,
    since only the variables of the value's own text are left out later. What
    the branches read several times is written once: resolved texts, distinct
    values with their colours, and the first variables of each colour.
    """
    known = index.join(resolved.select("name", F.coalesce(F.nullif("resolved_value", F.lit("")), F.col("value")).alias("text")), "name").where("text <> ''")
    known = written(known.select(F.col("name").alias("candidate"), "text", F.lower(js_trim(F.col("text"))).alias("key"), "is_color", "use_count", "pattern_ord", F.col("path").alias("c_path"), "offset"), "known")
    wanted = values.select("value").distinct().where("value is not null")
    wanted = written(wanted.select("value", F.lower(js_trim(F.col("value"))).alias("key"), F.when(is_color(F.col("value")), parse_color(F.col("value"))).alias("c")), "wanted")
    order = [F.desc("use_count"), *ORDER]
    top = lambda df, n, *keys: df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
    exact = wanted.join(top(known, limit, "key"), "key").select("value", "candidate", F.lit(100.0).alias("score"), "use_count", *ORDER)
    shades = lambda df, *keep: df.where("c is not null").select(*keep, *[F.col(f"c.{x}").alias(x) for x in CUBE])
    colors = shades(known.where("is_color").withColumn("c", parse_color(F.col("text"))), "candidate", "key", "use_count", *ORDER)
    colors = written(top(top(colors, limit, "key", *CUBE), 2 * limit, *CUBE), "colors")
    asked = shades(wanted, "value", "key")
    near = asked.join(_nearest(asked.select(*CUBE).distinct(), colors, order, 2 * limit), CUBE).select("value", F.col("key").alias("own"), F.explode("hits").alias("h")).select("value", "own", "h.*").where("key <> own")
    near = near.withColumn("score", F.greatest(F.lit(0.0), 50 - F.sqrt(F.col("square").cast("double")) / 5)).where("score > 10").select("value", "candidate", "score", "use_count", *ORDER)
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), *order))
    return exact.unionByName(near).withColumn("rank", rank).where(F.col("rank") <= limit).select("value", "rank", "candidate", "score")


def code_actions(diagnostics: DataFrame, files: DataFrame, index: DataFrame, resolved: DataFrame) -> DataFrame:
    """Quick fixes of every finding: rank, title, edit range, new text, is_preferred.

    A hardcoded finding's range becomes var(name), the first suggestion
    preferred. For an undefined name the first call of it on the finding's line
    (a longer name may match) takes the similar name and keeps its fallback; an
    action without such a call has no edit.
    """
    key = ["path", "phase", "o0", "o1", "o2", "kind", "start_line", "start_col", "end_line", "end_col"]
    hard = diagnostics.where(F.col("kind") == HARDCODED)
    hard = hard.join(variables_for_values(hard.select("value"), index, resolved), "value")
    hard = hard.select(
        *key, "rank", F.concat(F.lit("Reemplazar con var("), "candidate", F.lit(")")).alias("title"), F.col("start_line").alias("edit_line"), F.col("start_col").alias("edit_start"),
        F.col("end_line").alias("edit_end_line"), F.col("end_col").alias("edit_end"), F.concat(F.lit("var("), "candidate", F.lit(")")).alias("new_text"), (F.col("rank") == 1).alias("is_preferred"),
    )
    missing = diagnostics.where(F.col("kind") == UNDEFINED)
    # the text of a line goes with each distinct place only
    places = missing.select("path", "start_line", "var_name").distinct().join(files.select("path", "text"), "path").withColumn("line", line_text(F.col("text"), F.col("start_line"))).drop("text")
    call = F.call_function("regexp_extract", F.col("line"), F.concat(F.lit(rf"var\([{WS}]*"), "var_name", F.lit(f"[{WS}]*")), F.lit(0))
    places = places.withColumn("call", call).withColumn("at", F.when(F.col("call") != "", F.call_function("instr", F.col("line"), F.col("call")) - 1)).select("path", "start_line", "var_name", "at", F.length("call").alias("size"))
    missing = missing.join(similar_names(missing.select(F.col("var_name").alias("name")), index), "var_name").join(places, ["path", "start_line", "var_name"])
    has = F.col("at").isNotNull()
    missing = missing.select(
        *key, "rank", F.concat(F.lit("¿Quisiste decir var("), "candidate", F.lit(")?")).alias("title"), F.when(has, F.col("start_line")).alias("edit_line"), F.col("at").alias("edit_start"),
        F.when(has, F.col("start_line")).alias("edit_end_line"), F.when(has, F.col("at") + F.col("size")).alias("edit_end"), F.when(has, F.concat(F.lit("var("), "candidate")).alias("new_text"), F.lit(False).alias("is_preferred"),
    )
    return hard.unionByName(missing)
