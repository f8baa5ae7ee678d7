"""Filter interaction audit: what each filter removes in every order, in long form with running windows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.exact_dedup import UPPER

#: Filters by name; the place of a name is its bit in a document's mask.
FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
CELL = ["part", "mask", "good", "toxic"]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a whole text (null: empty) fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic and n: documents counted by the filters that they fail.

    Filter E fails a document whose text a smaller id has. Copies of a text agree
    in every other bit, so they are counted by text hash, part and label first,
    with map-side combining; then each hash has a few rows, of which those with
    its smallest id are told apart. No text and no group of copies is shuffled.
    """
    # one pass over the texts; from here on rows are narrow
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("h"), text_failures(F.col(text_col)).alias("mask"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(said, rows["id"] == said["__id"], "left").select("id", "part", "h", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by_id = rows.groupBy("id", "h", *CELL).agg(F.count("*").alias("n"))
    # a null id is larger than any other
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    groups = by_id.groupBy("h", *CELL).agg(F.sum("n").alias("n"), F.min(F.struct(*[place[k].alias(k) for k in ("none", "id")], "n")).alias("low"))
    first = F.min(F.struct("low.none", "low.id")).over(Window.partitionBy("h"))
    groups = groups.withColumn("passes", F.when(F.struct("low.none", "low.id") == first, F.col("low.n")).otherwise(F.lit(0)))
    own = [F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))]
    split = groups.select("part", "good", "toxic", F.explode(F.array(*own)).alias("c")).select("part", "c.mask", "good", "toxic", "c.n").where("n > 0")
    return split.groupBy(*CELL).agg(F.sum("n").alias("n"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Metrics of every part, order and step from cells of part, mask, good, toxic and n.

    Each cell is unpivoted against all orders and their steps. Over the steps of
    an order a running bit-or of failures tells whether a cell is gone already;
    sums over conditions give the counts, and totals over part and filter the
    Shapley sums. The work depends on parts and labels, not on documents.
    """
    orders = ["".join(p) for p in permutations(filters)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << filters.index(f)).alias("bit")) for o in orders for k, f in enumerate(o)])
    long = cells.select(*CELL, "n", F.explode(steps).alias("s")).select(*CELL, "n", "s.*")
    before = Window.partitionBy(*CELL, "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("here", here).withColumn("gone", F.coalesce(F.bit_or("here").over(before), F.lit(0)) > 0)
    fails, gone = F.col("here") > 0, F.col("gone")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"), total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Five filters fail a document: A under 100 words; B 100 * distinct words < 80
    * words; C over 10 percent capitals A-Z; D one of #$%&*|; E a text that a
    smaller id has too. One row, zeros included, for each part, each of the 120
    orders and each of its five steps.

    A null text is empty (no words: fails A, not B or C); a null part is the
    empty string. A null id is larger than any other, and rows that share the
    smallest id of a text all pass E. An id with several label rows is good or
    toxic if any of them says so; ids without labels, and null ids, are neither.
    Extra columns are ignored; an empty table gives an empty result.
    """
    return audit(mask_cells(docs, labels, id_col, text_col, part_col))
