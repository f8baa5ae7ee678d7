"""The project-wide index of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.parse import document_uses


def variable_index(definitions: DataFrame) -> DataFrame:
    """name, value, path, line, col, offset, is_color, pattern_ord: the first definition of each name.

    First by the ordinal of the glob, then path, then place; a map-side
    combined aggregate, so a name that every file defines does not gather.
    """
    first = F.min_by(F.struct("value", "path", "line", "col", "offset", "is_color", "pattern_ord"), F.struct("pattern_ord", "path", "offset"))
    return definitions.groupBy("name").agg(first.alias("v")).select("name", "v.*", F.lit(0).cast("long").alias("use_count"))


def with_order(index: DataFrame) -> DataFrame:
    """Adds idx_ord, the place of a variable in index order, as an orderable struct: no global sort is needed."""
    return index.withColumn("idx_ord", F.struct("pattern_ord", "path", "offset"))


def index_stats(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """n_variables, n_files and the time of the count."""
    n = index.agg(F.count("*").alias("n_variables"))
    return n.join(scanned.agg(F.countDistinct("path").alias("n_files"))).withColumn("updated", F.current_timestamp())


def definitions_per_file(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("path").agg(F.count("*").alias("n_definitions"))


def use_counts(files: DataFrame) -> DataFrame:
    """Uses of each name anywhere in the documents."""
    return document_uses(files).groupBy("name").agg(F.count("*").alias("uses"))


def with_use_counts(index: DataFrame, files: DataFrame) -> DataFrame:
    counts = use_counts(files)
    return index.drop("use_count").join(counts, "name", "left").withColumn("use_count", F.coalesce("uses", F.lit(0)).cast("long")).drop("uses")


def search_by_name(index: DataFrame, text: str) -> DataFrame:
    """Variables whose name contains a text, without regard to case."""
    return index.where(F.contains(F.lower("name"), F.lit(text.lower())))


def search_by_keywords(index: DataFrame, words: list[str]) -> DataFrame:
    """Variables whose name contains one of the words, without regard to case."""
    return index.where(F.exists(F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"), lambda w: F.contains(F.lower("name"), w)))


#: Shares into which a ranked table is cut, and rows of it that are looked at for each cut.
SHARES, LOOKED = 512, 16
#: Cuts between two of those that a place is compared with first.
STEP = 23


def by_usage(index: DataFrame) -> DataFrame:
    """Variables by falling use count, then index order, with their rank.

    The table is cut by ranges of the order, at places that SHARES * LOOKED
    names of least hash stand for; a share's rows are ranked by themselves and
    follow the rows of the shares before it, so no task sorts the whole index.
    """
    place = F.struct((-F.col("use_count")).alias("u"), "pattern_ord", "path", "offset")
    sample = index.select(place.alias("place"), F.xxhash64("name").alias("h")).orderBy("h", "place").limit(SHARES * LOOKED)
    every = F.greatest(F.lit(1), F.ceil(F.size("places") / SHARES)).cast("int")
    cuts = sample.agg(F.array_sort(F.collect_list("place")).alias("places")).select(F.filter("places", lambda _, i: i % every == 0).alias("cuts"))
    # one row of at most SHARES places, so the join is with a constant
    # a place is compared with every STEP-th cut, then with those between two of them
    cuts = cuts.select("cuts", F.filter("cuts", lambda _, i: i % STEP == 0).alias("coarse"))
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("__place")))
    dealt = index.withColumn("__place", place).join(F.broadcast(cuts)).withColumn("__from", F.greatest(F.lit(0), below("coarse") - 1) * STEP)
    dealt = dealt.withColumn("__share", F.col("__from") + below(F.slice("cuts", F.col("__from") + 1, F.lit(STEP)))).drop("cuts", "coarse", "__place", "__from")
    counts = dealt.groupBy("__share").agg(F.count("*").alias("__n"))
    before = counts.select("__share", (F.sum("__n").over(Window.orderBy("__share")) - F.col("__n")).cast("int").alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__share").orderBy(F.desc("use_count"), "pattern_ord", "path", "offset"))
    return dealt.join(F.broadcast(before), "__share").withColumn("rank", F.col("__before") + rank).drop("__share", "__before")


def quick_list(index: DataFrame) -> DataFrame:
    """Label, description and detail of each variable for a picker."""
    detail: Column = F.concat(F.lit("\U0001f4c1 "), F.regexp_extract("path", r"[^/\\]*\z", 0), F.lit(" · Línea "), F.col("line") + 1)
    return index.select(F.col("name").alias("label"), F.col("value").alias("description"), F.when(F.col("use_count") > 0, F.concat(detail, F.lit(" · Usos: "), F.col("use_count"))).otherwise(detail).alias("detail"))
