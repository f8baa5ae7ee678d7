"""Hard-negative mining over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import materialise, small_batches

CELLS = 64  # cells of a dimension; a code is one byte
BLOCK = 1 << 19  # components of a block of rows
ANCHORS = 1 << 14  # components of a block of anchors
EXACT = 1 << 53  # below it sums of whole numbers are exact in double precision
LONG = (1 << 63) - 1
BLOCKS = "dim int, block long, keys binary, ids binary, labels binary, kind string, vectors binary, codes binary, low binary, high binary"
ASKED = "dim int, ablock long, akeys binary, aids binary, alabels binary, avectors binary, windows array<array<array<long>>>"
POSITIVES = "akey long, anchor_id long, pkey long, positive_id long, score long"
NEGATIVES = "akey long, anchor_id long, place int, positive_id long, positive_score long, nkey long, negative_id long, negative_score long"


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * component), held to 44 bits."""
    top = float(1 << 44)
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-top)), F.lit(top))).cast("long"))


def usable(label: Column, vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & good, F.lit(False))


def _matrix(rows: pd.Series, size: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), size)


def _pack_rows(group: pd.DataFrame) -> pd.DataFrame:
    """One block: rows in order of their label, exact components, one byte for each cell, and the cells' ends."""
    group = group.sort_values(["label", "key"], kind="stable")
    size = int(group["dim"].iloc[0])
    exact = _matrix(group["vector"], size)
    codes, low, high = np.zeros((size, len(exact)), np.uint8), np.zeros((size, CELLS), np.int64), np.zeros((size, CELLS), np.int64)
    for d in range(size):
        column = exact[:, d]
        ranked = np.sort(column)
        cuts = np.unique(ranked[(np.arange(1, CELLS) * len(ranked)) // CELLS])  # equally full cells
        cell = np.searchsorted(cuts, column, side="right")
        codes[d] = cell
        first = np.searchsorted(ranked, cuts, side="left")
        starts, ends = np.concatenate([[0], first]), np.concatenate([first, [len(ranked)]])
        full = starts < ends  # the first cell may be empty
        low[d, : len(starts)][full], high[d, : len(starts)][full] = ranked[starts[full]], ranked[ends[full] - 1]
    kind = next(k for k in ("<i2", "<i4", "<i8") if not exact.size or max(-int(exact.min()) - 1, int(exact.max())) <= np.iinfo(k).max)
    out = (size, int(group["block"].iloc[0]), *(group[c].to_numpy("<i8").tobytes() for c in ("key", "vec_id", "label")), kind, exact.astype(kind).tobytes(), codes.tobytes(), low.astype("<i8").tobytes(), high.astype("<i8").tobytes())
    return pd.DataFrame([out], columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _pack_anchors(group: pd.DataFrame) -> pd.DataFrame:
    size = int(group["dim"].iloc[0])
    out = (size, int(group["ablock"].iloc[0]), *(group[c].to_numpy("<i8").tobytes() for c in ("key", "vec_id", "label")), _matrix(group["vector"], size).astype("<i8").tobytes(), [[x.tolist() for x in w] for w in group["windows"]])
    return pd.DataFrame([out], columns=[c.split()[0] for c in ASKED.split(", ")])


class _Pair:
    """A block of rows and a block of anchors, as arrays."""

    def __init__(self, row):
        size = int(row.dim)
        self.keys, self.ids, self.labels, self.akeys, self.aids, self.alabels = (np.frombuffer(b, "<i8") for b in (row.keys, row.ids, row.labels, row.akeys, row.aids, row.alabels))
        self.exact = np.frombuffer(row.vectors, row.kind).reshape(len(self.keys), size)
        self.codes = np.frombuffer(row.codes, np.uint8).reshape(size, len(self.keys))
        self.low, self.high = (np.frombuffer(b, "<i8").reshape(size, CELLS).astype(float) for b in (row.low, row.high))
        self.anchors = np.frombuffer(row.avectors, "<i8").reshape(len(self.akeys), size)
        self.windows = row.windows
        most = int(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))
        self.sure = size * most * int(np.abs(self.anchors).max(initial=0)) < EXACT

    def span(self, label: int) -> tuple[int, int]:
        """Rows of a label."""
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def bounds(self, k: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the cells of rows start to end allow with anchor k, by table lookup."""
        a = self.anchors[k].astype(float)[:, None]
        ends = a * self.low, a * self.high
        least, most = np.minimum(*ends), np.maximum(*ends)
        lower, upper = np.zeros(end - start), np.zeros(end - start)
        for d, codes in enumerate(self.codes[:, start:end]):
            lower += least[d].take(codes)
            upper += most[d].take(codes)
        if not self.sure:  # room for what rounding loses
            slack = 1e-12 * np.maximum(np.abs(least), np.abs(most)).max(1).sum() + 1
            lower, upper = lower - slack, upper + slack
        return lower, upper

    def scores(self, k: int, rows: np.ndarray) -> list[int]:
        if self.sure:
            return (self.exact[rows].astype(float) @ self.anchors[k].astype(float)).astype(np.int64).tolist()
        return (self.exact[rows].astype(object) @ self.anchors[k].astype(object)).tolist()

    def best(self, scored: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The first n of (score, row): higher scores, then smaller ids."""
        return sorted(scored, key=lambda s: (-s[0], self.ids[s[1]], self.keys[s[1]]))[:n]


def _at_least(values: np.ndarray, n: int) -> float:
    """The n-th greatest value; without end where there are fewer."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -np.inf


def _held(score: int) -> int:
    return max(-LONG, min(LONG, score))


def _find_positives(n: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pair, out = _Pair(row), []
                for k, label in enumerate(pair.alabels.tolist()):
                    start, end = pair.span(label)
                    if start == end:
                        continue
                    lower, upper = pair.bounds(k, start, end)
                    other = pair.keys[start:end] != pair.akeys[k]
                    rows = start + np.flatnonzero(other & (upper >= _at_least(lower[other], n)))
                    for score, r in pair.best(list(zip(pair.scores(k, rows), rows.tolist(), strict=True)), n):
                        out.append((pair.akeys[k], pair.aids[k], pair.keys[r], pair.ids[r], _held(score)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in POSITIVES.split(", ")])

    return found


def _find_negatives(n: int, low: int, high: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pair, out = _Pair(row), []
                for k, label in enumerate(pair.alabels.tolist()):
                    asked = [w.tolist() for w in pair.windows[k] if w[2] >= 0]  # below 0 a window is empty
                    start, end = pair.span(label)
                    if not asked or end - start == len(pair.keys):
                        continue
                    lower, upper = pair.bounds(k, 0, len(pair.keys))
                    lower[start:end] = upper[start:end] = -np.inf  # the anchor's own label
                    known: dict[int, int] = {}
                    for place, positive, score in asked:
                        least, most = low * score / 100, high * score / 100
                        inside = (lower >= least) & (upper <= most)
                        rows = np.flatnonzero((upper >= max(least, _at_least(lower[inside], n)) - 1) & (lower <= most + 1))
                        new = np.array([r for r in rows.tolist() if r not in known], dtype=np.int64)
                        known.update(zip(new.tolist(), pair.scores(k, new), strict=True))
                        fits = [(known[r], r) for r in rows.tolist() if low * score <= 100 * known[r] <= high * score]
                        for other, r in pair.best(fits, n):
                            out.append((pair.akeys[k], pair.aids[k], place, positive, score, pair.keys[r], pair.ids[r], _held(other)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in NEGATIVES.split(", ")])

    return found


def _first(df: DataFrame, by: list[str], score: str, *ties: str, n: int, name: str) -> DataFrame:
    """The first n rows of each group; each task sends on at most n of a group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    return df.withColumn(name, place).where(F.col(name) <= n)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product of these
    whole numbers. For each row that the condition anchors holds for: its first
    positives other rows of the same label are its positives, and for each of
    them the first negatives rows of other labels whose score is from low to
    high percent of the positive's, by falling score and then id. The condition
    reads the columns of vectors.

    Rows lie in blocks, dealt by a hash, with equally full cells in each
    dimension. A block of anchors meets each block of rows once: tables give
    bounds of all scores from the rows' one-byte cells, and only rows that may
    come among the first of a window are scored exactly. Blocks are bounded in
    components, so no label, however common, gathers in a task.

    Rows whose label, vector or id is null, or with a null or non-finite
    component, take no part; nor do rows of another length meet. Rows that
    repeat an id are rows of their own; among equal scores and ids the order is
    any. Components are held to 44 bits and scores to 64. An anchor without
    another row of its label, or a positive without a fitting row, gives no row.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = vectors.where(usable(F.col(label_col), F.col(vector_col)) & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"), whole_components(F.col(vector_col), scale).alias("vector"))
    rows = materialise(own.withColumn("dim", F.size("vector")).withColumn("key", F.monotonically_increasing_id()), "negatives-rows")
    # one row for each length of vectors
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("n_asked"))
    parts = lambda n, held: F.greatest(F.lit(1), F.ceil(F.col(n) * F.col("dim") / held)).cast("long")
    sizes = sizes.select("dim", parts("n", BLOCK).alias("blocks"), parts("n_asked", ANCHORS).alias("ablocks"))
    dealt = rows.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("ablock", F.pmod(F.xxhash64("key"), F.col("ablocks")))
    blocks = materialise(dealt.select("dim", "block", "key", "vec_id", "label", "vector").groupBy("dim", "block").applyInPandas(_pack_rows, BLOCKS), "negatives-blocks")

    def asked_of_all(asked: DataFrame) -> DataFrame:
        """Each block of anchors beside each block of rows: the anchors, a hundredth of the data, are what travels."""
        packed = asked.select("dim", "ablock", "key", "vec_id", "label", "vector", "windows").groupBy("dim", "ablock").applyInPandas(_pack_anchors, ASKED)
        return packed.join(sizes.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "ablock").join(blocks, ["dim", "block"])

    chosen = dealt.where("asked")
    found = asked_of_all(chosen.withColumn("windows", F.array().cast("array<array<long>>"))).mapInPandas(_find_positives(positives), POSITIVES)
    found = _first(found, ["akey"], "score", "positive_id", "pkey", n=positives, name="place")
    windows = found.groupBy("akey").agg(F.collect_list(F.array(F.col("place").cast("long"), "positive_id", "score")).alias("windows"))
    windows = materialise(windows, "negatives-positives")
    found = asked_of_all(chosen.join(windows, F.col("key") == F.col("akey"))).mapInPandas(_find_negatives(negatives, low, high), NEGATIVES)
    found = _first(found, ["akey", "place"], "negative_score", "negative_id", "nkey", n=negatives, name="rank")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
