"""Text recipes on columns: trimming, match offsets, positions, first replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class that holds JavaScript's white space.
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same characters, one by one.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the optimiser copies no expression into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(value: Column) -> Column:
    """Strip all white space that JavaScript strips."""
    return F.btrim(value, F.lit(BLANKS))


#: Elements of which a running total is made at once; see starts.
CHUNK = 64


def place(offset: Column, line: Column, col: Column) -> Column:
    """struct<offset, line, col>, all from 0: a position, or how far a text moves one."""
    return F.struct(offset.cast("int").alias("offset"), line.cast("int").alias("line"), col.cast("int").alias("col"))


def extent(text: Column) -> Column:
    """How far a text moves a position."""
    size = F.length(text)
    broken = F.contains(text, F.lit("\n"))
    lines = F.when(broken, size - F.length(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(0)
    return place(size, lines, F.when(broken, F.length(F.substring_index(text, "\n", -1))).otherwise(size))


def moved(at: Column, by: Column) -> Column:
    """A position after an extent."""
    return place(at["offset"] + by["offset"], at["line"] + by["line"], F.when(by["line"] > 0, by["col"]).otherwise(at["col"] + by["col"]))


def starts(extents: Column) -> Column:
    """The position before each of an array of extents, the first at the text's start.

    Running totals are made over chunks and over the chunks' totals, so the work
    is in proportion to the array but for one part in CHUNK squared.
    """
    zero = place(F.lit(0), F.lit(0), F.lit(0))
    none = F.array().cast("array<struct<offset:int,line:int,col:int>>")

    def running(items: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("before"))
        return F.aggregate(items, start, lambda acc, e: F.struct(moved(acc["at"], e).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))

    def placed(e: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(first, lambda k: running(F.slice(e, k, F.lit(CHUNK))))
        joined = lambda c: F.flatten(F.zip_with(running(F.transform(c, lambda x: x["at"]))["before"], c, lambda top, x: F.transform(x["before"], lambda p: moved(top, p))))
        return F.when(F.size(e) <= CHUNK, running(e)["before"]).otherwise(let(chunks, joined))

    return let(extents, placed)


def split_at(text: Column, mark: str) -> Column:
    """array<struct<text, at>> of the parts between marks, and where they begin; a mark is one letter without a meaning in patterns, no line feed."""

    def placed(parts: Column) -> Column:
        over = F.transform(parts, lambda p: let(extent(p), lambda e: place(e["offset"] + 1, e["line"], e["col"] + 1)))
        return F.zip_with(parts, starts(over), lambda p, at: F.struct(p.alias("text"), at.alias("at")))

    return let(F.split(text, mark, -1), placed)


#: Parts between marks that a piece of a text has at most.
PIECE = 32


def pieces(text: Column, masked: Column, mark: str, counted: Callable[[Column], Column]) -> Column:
    """array<struct<text, masked, first, at>>: a text cut at every PIECE-th mark, its masked form cut at the same places.

    at is where a piece begins, first how many parts before it count. A mark is
    one letter without a meaning in patterns, no line feed; both forms have the
    same marks. A text of few parts, as most are, is one piece and costs nothing;
    positions inside a piece are found by plain expressions on its beginning.
    """
    whole = F.array(F.struct(text.alias("text"), masked.alias("masked"), F.lit(0).alias("first"), place(F.lit(0), F.lit(0), F.lit(0)).alias("at")))

    def cut(s: Column) -> Column:
        def of(i: Column) -> Column:
            own = F.slice(s["t"], i, F.lit(PIECE))
            return F.struct(F.array_join(own, mark).alias("text"), F.array_join(F.slice(s["m"], i, F.lit(PIECE)), mark).alias("masked"), F.size(F.filter(own, counted)).alias("n"))

        return F.transform(F.sequence(F.lit(1), F.size(s["t"]), F.lit(PIECE)), of)

    def placed(all_: Column) -> Column:
        at = starts(F.transform(all_, lambda x: extent(F.concat(x["masked"], F.lit(mark)))))
        first = starts(F.transform(all_, lambda x: place(x["n"], F.lit(0), F.lit(0))))
        both = F.zip_with(at, first, lambda a, n: F.struct(a.alias("at"), n["offset"].alias("first")))
        return F.zip_with(all_, both, lambda x, b: F.struct(x["text"].alias("text"), x["masked"].alias("masked"), b["first"].alias("first"), b["at"].alias("at")))

    marks = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return F.when(marks < PIECE, whole).otherwise(let(F.struct(F.split(text, mark, -1).alias("t"), F.split(masked, mark, -1).alias("m")), lambda s: let(cut(s), placed)))


def upto(text: Column, mark: str, k: Column) -> Column:
    """The beginning of a text up to and with its k-th mark; empty for 0."""
    return F.when(k > 0, F.concat(F.call_function("substring_index", text, F.lit(mark), k), F.lit(mark))).otherwise("")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<offset, line, col, match>> of a pattern's matches and where they begin, from 0, in one pass.

    The text is cut at the matches; what lies between and the matches themselves
    add up to the positions. A lone match is looked up: had its text stood any
    earlier, the leftmost match would have been there. Patterns look at nothing
    outside their match.
    """
    at = lambda p, m: F.struct(p["offset"].alias("offset"), p["line"].alias("line"), p["col"].alias("col"), m.alias("match"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def alone(all_: Column) -> Column:
        return F.transform(all_, lambda m: at(extent(F.substring(text, F.lit(1), F.call_function("instr", text, m) - 1)), m))

    def several(all_: Column) -> Column:
        parts = F.flatten(F.zip_with(F.split(text, pattern, -1), all_, lambda gap, m: F.array(gap, F.coalesce(m, F.lit("")))))
        return let(starts(F.transform(parts, extent)), lambda begin: F.transform(all_, lambda m, k: at(F.get(begin, 2 * k + 1), m)))

    return let(found, lambda all_: F.when(F.size(all_) <= 1, alone(all_)).otherwise(several(all_)))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 0, of an offset: line feeds before it."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def column_of(text: Column, offset: Column) -> Column:
    """Column, from 0, of an offset: characters since the last line feed."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1))


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """Offset of a position; lines past the end count as the text's end."""
    lines = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line), F.lit(0), lambda s, x: s + F.length(x) + 1)
    return F.least(before, F.length(text)) + column


def line_text(text: Column, line: Column) -> Column:
    """A line without its end; empty outside the text."""
    return F.coalesce(F.get(F.split(text, "\n", -1), line), F.lit(""))


def replace_first(value: Column, what: Column, by: Column) -> Column:
    """Replace the first occurrence, taken literally."""
    at = F.call_function("instr", value, what)
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), by, F.substring(value, at + F.length(what), F.length(value)))).otherwise(value)


def splice(text: Column, start: Column, end: Column, by: Column) -> Column:
    """Replace the characters from start to end, offsets from 0."""
    return F.concat(F.substring(text, F.lit(1), start), by, F.substring(text, end + 1, F.length(text)))


def string_hash(text: Column) -> Column:
    """31-multiplier hash wrapped to 32 bits; characters beyond U+FFFF count as their code point."""
    top = 2**32
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: (s * 31 + F.when(c == "", F.lit(0)).otherwise(F.ascii(c))) % top)
    total = F.when(F.length(text) > 0, total).otherwise(F.lit(0).cast("long"))
    return F.when(total >= 2**31, total - top).otherwise(total).cast("int")
