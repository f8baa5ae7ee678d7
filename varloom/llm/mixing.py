"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3  # times that a block, and so a document, may be taken


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share
    the sum of all sizes. A target stops at CAP times its source's size and the
    excess is reshared by weight: the common level is found on the sources
    ordered by the level at which each one stops. The windows run over one row
    for each source, never over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", (CAP * F.col("source_size")).cast("double")).withColumn("stop", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("stop"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in order of its stop, that the level no longer fills fixes the level of all that follow
    s = s.withColumn("found", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", F.coalesce("source", F.lit("")), F.col("level").alias("level")))).over(everything))
    level = F.coalesce(F.col("found.level"), F.lit(float("inf")))
    return s.select("source", "source_size", F.least(F.col("cap"), F.when(F.col("source_size") > 0, level * F.col("w")).otherwise(F.lit(0.0))).alias("target"))


def _permuted(index: Column, n: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: a swap-or-not shuffle.

    Each of 48 rounds pairs x with (k - x) mod n and a hash of the pair decides
    whether they swap, so it is a bijection for any n and needs no table.
    """
    x = index
    rounds = F.sequence(F.lit(0), F.lit(47))

    def step(x, r):
        k = F.pmod(F.xxhash64(F.lit("pivot"), r, *keys), n)
        y = F.pmod(k - x, n)
        swap = F.pmod(F.xxhash64(F.greatest(x, y), r, *keys), F.lit(2)) == 1
        return F.when(swap, y).otherwise(x)

    return F.aggregate(rounds, x, step)


def _offsets(counts: DataFrame, key: str, order: str, value: str, group: int = 4096) -> DataFrame:
    """Adds ``base``: the sum of value over the rows of the same key (nulls are one key) that come earlier in order.

    order holds integers from 0, one row for each (key, order). Sums run inside
    groups of consecutive orders, then over the groups, so no task sees all rows
    of a key.
    """
    c = counts.withColumn("__g", F.expr(f"`{order}` div {group}"))
    inner = Window.partitionBy(key, "__g").orderBy(order)
    c = c.withColumn("__in", F.sum(value).over(inner) - F.col(value))
    groups = counts.groupBy(key, F.expr(f"`{order}` div {group}").alias("__g")).agg(F.sum(value).alias("__v"))
    groups = groups.withColumn("__base", F.sum("__v").over(Window.partitionBy(key).orderBy("__g")) - F.col("__v"))
    g = groups.select(F.col(key).alias("__key"), F.col("__g").alias("__gg"), "__base")
    joined = c.join(g, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__g") == F.col("__gg")))
    return joined.withColumn("base", F.col("__base") + F.col("__in")).drop("__g", "__in", "__key", "__gg", "__base")


def _locate(points: DataFrame, intervals: DataFrame, top: int) -> DataFrame:
    """Joins each point x to the interval [lo, hi) that holds it, by equality on cells of the range 0..top."""
    width = max(1, top // 4096)
    cells = intervals.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    return points.withColumn("cell", F.expr(f"x div {width}")).join(cells, "cell").where("x >= lo and x < hi").drop("cell")


def _slots(spark, plan: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """shard, source, n_blocks, k: the slots of the mix, numbered within their source from 0 to owed - 1."""
    from varloom.llm.common import materialise

    n_slots = plan.agg(F.sum("owed")).first()[0] or 0
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    owed = plan.select("source", "n_blocks", "owed").withColumn("hi", F.sum("owed").over(by_source)).withColumn("lo", F.col("hi") - F.col("owed"))
    drawn = spark.range(n_slots).select(F.expr(f"id div {shard_slots}").alias("shard"), "id", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), F.expr(f"id div {shard_slots}"), F.expr(f"id % {shard_slots}")), F.lit(max(1, n_slots))).alias("x"))
    drawn = _locate(drawn, owed.select("source", "lo", "hi"), n_slots).select("source", "shard", "id")
    counts = drawn.groupBy("source", "shard").agg(F.count("*").alias("n"))
    counts = _offsets(counts, "source", "shard", "n")
    counts = counts.select(F.col("source").alias("s"), F.col("shard").alias("h"), "base")
    within = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source", "shard").orderBy("id")) - 1)
    numbered = within.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).select("shard", "source", (F.col("base") + F.col("r")).alias("k"))
    got = numbered.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "s")
    books = plan.join(got, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_blocks", "owed", F.coalesce("got", F.lit(0)).alias("got"))
    books = books.withColumn("over", F.greatest(F.lit(0), F.expr("got - owed"))).withColumn("under", F.greatest(F.lit(0), F.expr("owed - got")))
    books = materialise(books.withColumn("over_lo", F.sum("over").over(by_source) - F.col("over")).withColumn("hi", F.sum("under").over(by_source)).withColumn("lo", F.col("hi") - F.col("under")), "mix-books")
    b = books.select(F.col("source").alias("s"), "n_blocks", "owed", "over_lo")
    known = numbered.join(b, F.col("source").eqNullSafe(F.col("s")))
    own = known.where("k < owed").select("shard", "source", "n_blocks", "k")
    passed = known.where("k >= owed").select("shard", (F.col("over_lo") + F.col("k") - F.col("owed")).alias("x"))
    passed = _locate(passed, books.select("source", "n_blocks", "got", "lo", "hi"), n_slots).select("shard", "source", "n_blocks", (F.expr("got + x - lo")).alias("k"))
    return own.unionByName(passed)


def _mix(docs: DataFrame, seed: int, block_words: int, shard_slots: int, rows_per_bucket: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents at their places in their sources' streams, the plan of each source, and the slots with their blocks i."""
    from varloom.llm.common import materialise

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows, "mix-sizes")
    n_rows = rows.count()
    targets = source_targets(rows)
    targets = materialise(targets, "mix-targets")
    # stream positions: hash buckets of bounded size, then a running sum inside each bucket
    n_buckets = max(1, n_rows // rows_per_bucket)
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(n_buckets)))
    totals = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    base = _offsets(totals, "source", "bucket", "words").drop("words")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("upto", F.sum("size").over(inside)).alias("p").join(base.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")))
    placed = placed.select("p.doc_id", "p.source", "p.size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    plan = (
        targets.withColumn("block", F.lit(block_words))
        .withColumn("n_blocks", F.expr("(source_size + block - 1) div block"))
        .withColumn("owed", F.when(F.col("n_blocks") > 0, F.least(CAP * F.col("n_blocks"), F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0)).cast("long"))
    )
    plan = materialise(plan, "mix-plan")
    slots = _slots(spark, plan, seed, shard_slots)
    n = F.col("n_blocks")
    return placed, plan, slots.withColumn("i", _permuted(F.expr("k % n_blocks"), n, F.lit(seed), F.coalesce("source", F.lit("\0")), F.expr("k div n_blocks")))


def mix_sources(docs: DataFrame, seed: int = 17, block_words: int = 128, shard_slots: int = 1024, rows_per_bucket: int = 500, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken.

    The words of a source, in an order fixed by a hash of the document, form a
    stream cut into blocks of block_words. The mix is a list of slots in output
    shards of shard_slots. Each shard draws the sources of its slots from a
    generator seeded by the shard: the counts of its sources are multinomial,
    and number its slots within each source; draws beyond what a source owes pass to
    sources that are owed slots, so totals meet the targets. The k-th slot of a
    source takes, in its pass k div n, the block that a pseudorandom permutation
    of the n block numbers gives for k mod n. Slots join blocks by number, and
    a document is taken in proportion to its share of the blocks used. No block
    is used more than three times.

    Null text has size 0; null sources are one source, ordered last. Documents
    of size 0 are taken 0 times. Rows that repeat an id are separate documents.
    Extra columns are ignored; an empty table gives an empty result. The same
    rows give the same result for any partitioning.
    """
    placed, plan, slots = _mix(docs, seed, block_words, shard_slots, rows_per_bucket, id_col, text_col, source_col)
    used = slots.groupBy("source", "i").agg(F.count("*").alias("times"))
    cut = placed.alias("d").join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).where("size > 0")
    pieces = cut.select("doc_id", "d.source", "size", "start", "block", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")).alias("i"))
    overlap = F.least(F.expr("start + size"), F.expr("(i + 1) * block")) - F.greatest(F.col("start"), F.expr("i * block"))
    taken = (
        pieces.withColumn("overlap", overlap).alias("c").join(used.alias("u"), F.col("c.source").eqNullSafe(F.col("u.source")) & (F.col("c.i") == F.col("u.i")))
        .groupBy("c.doc_id", "c.source", "c.start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    )
    out = placed.alias("d").join(taken.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d.start") == F.col("x.start")) & (F.col("d.size") > 0), "left")
    out = out.join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.select(F.col("d.doc_id").alias(id_col), F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_shards(docs: DataFrame, seed: int = 17, block_words: int = 128, shard_slots: int = 1024, rows_per_bucket: int = 500, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """shard, source, block: the slots of every output shard of the mix of :func:`mix_sources`."""
    slots = _mix(docs, seed, block_words, shard_slots, rows_per_bucket, id_col, text_col, source_col)[2]
    return slots.select("shard", "source", F.col("i").alias("block"))
