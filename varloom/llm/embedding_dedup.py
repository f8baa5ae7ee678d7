"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import connected_components, materialise

TILE = 1024  # vectors of a tile
LEAD = 8  # leading dimensions whose ranges bound a whole tile
STEPS = (8, 16, 32)  # dimensions after which pairs are dropped
CLOSE = 1e-6  # pairs this close to the threshold are computed again from the vectors as given


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero, not empty."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def fit_pca(vectors: DataFrame, sample_rows: int) -> np.ndarray:
    """Rotation, columns by falling variance, from about sample_rows vectors at most; identity where there are too few.

    The vectors are those of the commonest length with the smallest hashes, so a
    random sample. Eight tasks at most send a table of length x length products
    each. Any rotation gives right results; the sample only decides how early
    pairs stop.
    """
    common = vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None or common["n"] < 2:
        return np.eye(common["dim"] if common else 1)
    size, share = common["dim"], min(1.0, sample_rows / common["n"])
    sample = vectors.where((F.col("dim") == size) & (F.pmod(F.xxhash64(F.lit("pca"), "rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("embedding")

    def products(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                unit = _unit(np.array(batch["embedding"].tolist(), dtype=np.float64))
                total += unit.T @ unit
        yield pd.DataFrame({"p": [total.tobytes()]})

    total = sum(np.frombuffer(r[0]).reshape(size, size) for r in sample.coalesce(8).mapInPandas(products, "p binary").collect())
    values, axes = np.linalg.eigh(total)
    return axes[:, np.argsort(-values)]


def _unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _pack(rotation: np.ndarray):
    """Tiles: rows of one group to matrices of at most TILE vectors, ordered along the first axes."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        ids, size = group["rep"].to_numpy(), int(group["dim"].iloc[0])
        raw = np.array(group["embedding"].tolist(), dtype=np.float64).reshape(len(ids), size)
        unit = _unit(raw)
        turned = unit @ rotation if size == len(rotation) else unit
        lead = turned[:, : min(LEAD, size)]
        parts, todo = [], [np.arange(len(ids))]
        while todo:  # halve along the widest leading axis, so that a tile's ranges are tight
            part = todo.pop()
            if len(part) <= TILE:
                parts.append(part)
                continue
            axis = np.ptp(lead[part], axis=0).argmax()
            order = part[np.argsort(lead[part, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        out = []
        for part in parts:
            x = lead[part]
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1))) if size > LEAD else np.zeros(len(part))
            out.append((int(ids[part].min()), group["label"].iloc[0], size, ids[part].astype("<i8").tobytes(), group["copies"].to_numpy()[part].astype("<i8").tobytes(), turned[part].astype("<f8").tobytes(), raw[part].astype("<f8").tobytes(), x.min(0).tolist(), x.max(0).tolist(), float(rest.max())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TILES.split(", ")])

    return packed


TILES = "tile long, label long, dim int, ids binary, copies binary, turned binary, raw binary, low array<double>, high array<double>, rest double"
FOUND = "a long, b long, n_links long"


def _compare(threshold: float):
    def compared(pair: pd.DataFrame) -> pd.DataFrame:
        return _tile_pair(next(pair.itertuples(index=False)), threshold)

    return compared


def _tile_pair(row, threshold: float) -> pd.DataFrame:
    """Links between two tiles (or inside one): a count for each vector and edges that span the linked sets."""
    size, same = row.dim, row.tile == row.tile_b
    ids, copies = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.copies, "<i8")
    other, other_copies = np.frombuffer(row.ids_b, "<i8"), np.frombuffer(row.copies_b, "<i8")
    x, y = (np.frombuffer(b, "<f8").reshape(-1, size) for b in (row.turned, row.turned_b))
    linked = np.zeros((len(ids), len(other)), bool)
    # leading dimensions for all pairs, then only the pairs whose suffix norms can still reach the threshold
    steps = [s for s in STEPS if s < size]
    suffix = lambda m, k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(1)))
    near = threshold - 1e-7
    first = steps[0] if steps else size
    partial = x[:, :first] @ y[:, :first].T
    i, j = np.nonzero(partial + np.outer(suffix(x, first), suffix(y, first)) >= near) if first < size else np.nonzero(partial >= near)
    if same:
        i, j = i[i < j], j[i < j]
    dots, at = partial[i, j], first
    for upto in [*steps[1:], size] if first < size else []:
        keep_i, keep_j, keep_d = [], [], []
        sx, sy = suffix(x, upto), suffix(y, upto)
        for s in range(0, len(i), 200_000):  # bounded memory however many pairs remain
            a, b = i[s : s + 200_000], j[s : s + 200_000]
            d = dots[s : s + 200_000] + np.einsum("ij,ij->i", x[a, at:upto], y[b, at:upto])
            ok = d + sx[a] * sy[b] >= near
            keep_i.append(a[ok]), keep_j.append(b[ok]), keep_d.append(d[ok])
        i, j, dots = (np.concatenate(k) if k else np.zeros(0, t) for k, t in ((keep_i, int), (keep_j, int), (keep_d, float)))
        at = upto
    close = np.abs(dots - threshold) < CLOSE
    sure = dots >= threshold
    if close.any():
        u, v = (np.frombuffer(b, "<f8").reshape(-1, size) for b in (row.raw, row.raw_b))
        sure[close] = [_cosine(u[a], v[b]) >= threshold for a, b in zip(i[close], j[close], strict=True)]
    linked[i[sure], j[sure]] = True
    counts = [(int(a), None, int(n)) for a, n in zip(ids, linked @ other_copies, strict=True) if n]
    counts += [(int(b), None, int(n)) for b, n in zip(other, linked.T @ copies, strict=True) if n]
    return pd.DataFrame(counts + _spanning(ids, other, linked, same), columns=["a", "b", "n_links"]).astype({"a": "Int64", "b": "Int64", "n_links": "Int64"})


def _cosine(u: np.ndarray, v: np.ndarray) -> float:
    """Cosine in double precision, scaled so that no product overflows."""
    u, v = u / np.abs(u).max(), v / np.abs(v).max()
    return float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())))


def _spanning(ids, other, linked, same) -> list:
    """Edges of a spanning forest of the links: at most one for each vector of the two tiles."""
    n = len(ids)
    ia, ib = np.nonzero(linked)
    ib = ib if same else ib + n
    parent = list(range(n if same else n + len(other)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    names, edges, left = (ids if same else np.concatenate([ids, other])), [], len(parent) - 1
    for a, b in zip(ia.tolist(), ib.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            edges.append((int(names[a]), int(names[b]), None))
            left -= 1
            if not left:
                break
    return edges


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, sample_rows: int = 20_000, rows_per_group: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Vectors with equal, non-null labels and equal length are linked when their
    cosine in double precision reaches the threshold (above 0). Equal vectors of
    a label are compared once and counted as often as they occur. Vectors are
    turned by a PCA fitted on at most sample_rows of them and packed in tiles of
    at most 1024; tile pairs whose leading ranges and suffix norms rule a link
    out are dropped, and the others accumulate leading dimensions first and drop
    pairs whose suffix norms cannot reach the threshold. Each tile pair returns
    counts and a spanning forest, never its pairs.

    Null, empty or zero vectors, those with a null or non-finite component, and
    null labels link with nothing: n_links 0, a component of their own. So do
    vectors whose id is null (component_id null, kept false). Rows that repeat
    an id are separate vectors of one name.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    fits = F.coalesce(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # -0.0 and 0.0 are the same component
    fit = own.where(fits).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    distinct = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    reps = materialise(distinct.withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    rotation = fit_pca(reps, sample_rows)
    tiles = materialise(_tiles(reps, rotation, rows_per_group), "tiles")
    found = _tile_pairs(tiles, threshold).groupBy("tile", "tile_b").applyInPandas(_compare(threshold), FOUND)
    found = materialise(found, "links")
    counts = found.where("n_links is not null").groupBy("a").agg(F.sum("n_links").alias("n")).withColumnRenamed("a", "rep")
    components = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = reps.join(components, "rep").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    judged = reps.join(counts, "rep", "left").join(components.join(named, "component"), "rep", "left")
    judged = judged.select("label", "embedding", F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = fit.join(judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = own.where(~fits).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _tiles(reps: DataFrame, rotation: np.ndarray, rows_per_group: int) -> DataFrame:
    """Groups of at most about rows_per_group vectors along the first axis inside a label, each packed in tiles.

    A group is sixteen neighbouring cells of the axis. Where these together hold
    more, each cell is a group by itself, cut by a hash where it alone holds more.
    """
    axis = rotation[:, 0].tolist()
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    along = total(F.zip_with("embedding", F.array(*[F.lit(x) for x in axis]), lambda a, b: a * b)) / F.sqrt(total(F.transform("embedding", lambda x: x * x)))
    along = F.when((F.col("dim") == len(axis)) & (F.abs(along) <= 2), along).otherwise(F.lit(0.0))
    crowd = reps.withColumn("cell", F.floor(along / 0.05)).withColumn("block", F.floor(F.col("cell") / 16))
    cells = crowd.groupBy("label", "dim", "block", "cell").agg(F.count("*").alias("n"))
    blocks = cells.groupBy("label", "dim", "block").agg((F.sum("n") > rows_per_group).alias("parted"))
    cells = cells.join(blocks, ["label", "dim", "block"]).select("label", "dim", "cell", "parted", F.expr(f"greatest(1, (n + {rows_per_group - 1}) div {rows_per_group})").alias("cuts"))
    crowd = crowd.join(cells, ["label", "dim", "cell"]).withColumn("group", F.when(F.col("parted"), F.col("cell")).otherwise(F.col("block") - 1000))
    crowd = crowd.withColumn("cut", F.when(F.col("parted"), F.pmod(F.xxhash64("rep"), F.col("cuts"))).otherwise(F.lit(0)))
    return crowd.groupBy("label", "dim", "group", "cut").applyInPandas(_pack(rotation), TILES)


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles of one label that may hold a link, with the contents of both.

    Summaries meet by equality on label and on cells of the first axis as wide
    as two linked unit vectors can be apart; ranges of the leading axes and the
    largest suffix norms then bound the cosine.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    narrow = tiles.select("tile", "label", "dim", "low", "high", "rest")
    first = lambda c: F.element_at(c, 1)
    cells = narrow.withColumn("cell", F.explode(F.sequence(F.floor(first("low") / reach), F.floor(first("high") / reach) + 1)))
    left = cells.select(*[F.col(c).alias(f"{c}_a") for c in narrow.columns], "cell")
    right = cells.select(*[F.col(c).alias(f"{c}_b") for c in narrow.columns], "cell")
    met = left.join(right, (F.col("label_a") == F.col("label_b")) & (F.col("dim_a") == F.col("dim_b")) & (left["cell"] == right["cell"])).where("tile_a <= tile_b").drop("cell")
    met = met.dropDuplicates(["tile_a", "tile_b"])
    box = F.arrays_zip("low_a", "high_a", "low_b", "high_b")
    gap = F.aggregate(box, F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["low_a"] - z["high_b"], z["low_b"] - z["high_a"]), F.lit(2)))
    best = F.aggregate(box, F.lit(0.0), lambda s, z: s + F.greatest(z["low_a"] * z["low_b"], z["low_a"] * z["high_b"], z["high_a"] * z["low_b"], z["high_a"] * z["high_b"]))
    met = met.where((gap <= reach * reach) & (best + F.col("rest_a") * F.col("rest_b") >= threshold - 1e-7)).select("tile_a", "tile_b")
    a = tiles.select("tile", "dim", "ids", "copies", "turned", "raw")
    b = tiles.select(F.col("tile").alias("tb"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "copies", "turned", "raw")])
    return met.join(a, F.col("tile_a") == F.col("tile")).join(b, F.col("tile_b") == F.col("tb")).drop("tile_a", "tb")
