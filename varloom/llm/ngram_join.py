"""N-gram Jaccard join: count vectors of hashed token groups, bounded by summed minima, then verified.

A document's distinct shingles are hashed, and the hash range is cut into groups
of neighbouring hashes; the counts of the groups are the document's point.
Points of one document at 32, 64, ... groups are nested, so a tree of boxes
over them needs no index of its own: a coarser point is a sum of a finer one.

Root of the tree: sets that may link must have one group of equal content among
their fullest groups, so equality on a group's content deals documents to small
clusters of candidates (a tree of boxes alone cannot: see the README). Star
edges of such groups are bounded by the summed minima of both points and
verified on whole sets. Where a cluster still has parts that no verified link
joins, its points are packed in tiles; boxes of tiles, boxes of leaves, coarse
points and fine points bound the overlap in turn, and what survives is verified
on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import connected_components, discard, materialise, small_batches, trim, worker_state
from varloom.llm.shingles import mix, shingle_sets

LEAST_PERCENT = 60  # below it two linked sets may differ in more elements than they have full groups
COARSE = 32  # coordinates of a box, and the least of a point
FINE = 8  # how much finer points are than what tells unrelated sets apart on average
TILE = 2048  # points of a tile
SMALL_TILE = 256  # points from which a crowd is cut into up to eight tiles, so that it goes to as many tasks
TILE_BYTES = 2 << 20  # bytes of the points of a tile, but for one that alone has more
LEAF = 16  # points of a leaf inside a tile
WIDTH = 64  # partners of one set in a pair of tiles that are verified in the first round
CONTENTS = 500_000  # group contents of a bucket, about
BROADCAST_ROWS = 300_000  # candidates, of under 100 bytes each, up to which they are broadcast; more are joined by shuffles
_U = np.uint64


def differ(total: int, percent: int) -> int:
    """Elements in which two linked sets of this total size may differ at most."""
    return total * (100 - percent) // (100 + percent)


class Levels:
    """How finely the hash range is cut for documents of a size, at a threshold of percent.

    Sizes are classed by powers of four; sets near a boundary also belong to a
    level for the links across it. A set sends the contents of its fullest
    groups, one more than the elements in which a linked set can differ. All
    sets order their groups alike, by falling size and then by place. Groups
    that come before the first common content in either set hold a differing
    element, so that content is among the sent ones of both.
    """

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
        self.percent = percent
        self.known: dict[int, list[tuple[int, int, int]]] = {}
        # the largest mean content of a group that leaves a quarter more non-empty groups than a set sends
        share = min(0.95, 1.25 * differ(10_000 + 1_000_000 // percent, percent) / 10_000)
        low, high = 1e-9, 100.0
        while high - low > 1e-6:
            mid = (low + high) / 2
            low, high = (mid, high) if -math.expm1(-mid) / mid >= share else (low, mid)
        self.content = low

    def groups(self, size: int) -> int:
        """Groups of a level whose largest sets have this size; small sets get many, so that few are empty-handed."""
        return max(math.ceil(size / self.content), 2 * min(size, 16))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(level, groups, differing elements) of each level that a set of n elements belongs to.

        A level where no element may differ is left out: equal sets are found without it.
        """
        found = self.known.get(n)
        if found is None:
            p, c = self.percent, (n.bit_length() - 1) // 2
            low, high = 4**c, 4 ** (c + 1)
            most, least = n * 100 // p, -(-n * p // 100)
            levels = [(2 * c, high - 1, n + min(most, high - 1))]
            if most >= high:
                levels.append((2 * c + 1, (high - 1) * 100 // p, n + most))
            if least < low:
                levels.append((2 * c - 1, (low - 1) * 100 // p, n + low - 1))
            found = self.known[n] = [(level, self.groups(size), d) for level, size, total in levels if (d := differ(total, p))]
        return found

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Values of the contents that a sorted set sends.

        A set with too few non-empty groups sends all groups, its empty ones too:
        then a linked set, which has a common content among any that it sends,
        has it here.
        """
        n, out = len(s), []
        total = np.concatenate([[_U(0)], np.cumsum(mix(s + _U(0x632BE59BD9B4E019)))])
        for level, m, d in self.of(n):
            place = (s >> _U(32)) * _U(m) >> _U(32)
            at = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
            end = np.concatenate([at[1:], [n]])
            content, place = total[end] - total[at], place[at]
            if len(at) > d:
                # places are in order already, so a stable sort by size orders as needed
                first = np.argsort(at - end, kind="stable")[: d + 1]
                content, place = content[first], place[first]
            else:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), place)
                content, place = np.concatenate([content, np.zeros(len(empty), np.uint64)]), np.concatenate([place, empty])
            out.append(mix(content + place * _U(0x8CB92BA72F3D8DD7) + _U(level * 0x9FB21C651E98DF25 % 2**64)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    a, b = mix(s + _U(1)).sum(dtype=np.uint64), mix(mix(s) + _U(0x94D049BB133111EB)).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def point_of(s: np.ndarray, percent: int) -> bytes:
    """Counts of a sorted set's groups, as many as tell unrelated sets of its size apart, as bytes where they fit."""
    apart = math.pi * (2 * (100 - percent) / (100 + percent)) ** 2
    bits = max(int(math.log2(COARSE)), math.ceil(math.log2(max(1.0, FINE * apart * len(s)))))
    counts = np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def read_point(point: bytes, n: int) -> np.ndarray:
    """Counts of a point of n elements; bytes add up to n, wider counts do not as bytes of a table as long."""
    counts = np.frombuffer(point, np.uint8)
    if counts.sum(dtype=np.int64) != n or len(counts) & (len(counts) - 1):
        counts = np.frombuffer(point, np.uint32)
    return counts


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (one, or a row each) at fewer groups."""
    if points.shape[-1] == groups:
        return points.astype(np.int32)
    return points.reshape(*points.shape[:-1], groups, -1).sum(-1, dtype=np.int32)


def needed(total, percent: int):
    """Least intersection of two linked sets of this total size."""
    return -(-total * percent // (100 + percent))


def may_link(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether the summed minima of two points allow a link."""
    groups = min(len(p), len(q))
    return int(np.minimum(fold(p, groups), fold(q, groups)).sum()) >= needed(int(p.sum(dtype=np.int64)) + int(q.sum(dtype=np.int64)), percent)


PASS = "bucket long, blob binary"
MET = "n long, doc_id long, key long, h1 long, h2 long, g1 long"
#: Bucket numbers say what a blob holds: below the number of buckets group contents, from there on documents or edges.
DOCS, EDGES = b"D", b"E"
#: Bytes of a content's value that go to its bucket. Values that agree by chance only make candidates.
VALUE = 5


def _first_pass(k: int, percent: int, buckets: int):
    """Blobs for the buckets: group contents by value; documents' sizes and set names, and star edges, anywhere.

    Equal sets of a batch are one; of the sets of a batch with an equal content
    only that with the smallest name goes on, the others are tied to it: what
    goes on does not grow with the number of copies in a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("ngram")
        levels = Levels(percent)
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), k)
            names = np.array([set_identity(s) for s in sets], np.int64).reshape(-1, 2)
            known = batch["doc_id"].notna().to_numpy()
            ids = batch["doc_id"].fillna(0).to_numpy().astype(np.int64)
            docs = np.column_stack([np.array([len(s) for s in sets], np.int64), known.astype(np.int64), ids, batch["key"].to_numpy(np.int64), names])
            place = buckets + int(np.uint64(names.sum()) % np.uint64(buckets))
            blobs = [(place, DOCS + docs.astype("<i8").tobytes())]
            distinct = {name: s for name, s in zip(map(tuple, names.tolist()), sets, strict=True) if len(s)}
            order = sorted(distinct)
            own = np.array([h1 for h1, _ in order], np.int64)
            each = [levels.signatures(distinct[name]) for name in order]
            value = np.concatenate(each) if each else np.zeros(0, np.uint64)
            index = np.repeat(np.arange(len(each)), [len(v) for v in each])
            at = np.argsort(value, kind="stable")
            value, index = value[at], index[at]
            if len(value):
                new = np.concatenate([[True], value[1:] != value[:-1]])
                pivot = index[new][np.cumsum(new) - 1]
                tied = np.unique(np.stack([pivot[~new], index[~new]], 1), axis=0)
                if len(tied):
                    blobs.append((place, EDGES + np.column_stack([own[tied[:, 0]], own[tied[:, 1]]]).astype("<i8").tobytes()))
                value, index = value[new], index[new]
                # buckets are ranges of the values' upper half; only those that have values are walked
                bucket = ((value >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                begin = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
                low = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :VALUE]
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(value)], strict=True):
                    used, local = np.unique(index[a:b], return_inverse=True)
                    blobs.append((int(bucket[a]), len(used).to_bytes(4, "little") + own[used].astype("<i8").tobytes() + local.astype("<u2").tobytes() + low[a:b].tobytes()))
            yield pd.DataFrame(blobs, columns=["bucket", "blob"])
        trim()

    return run


def _meet(buckets: int):
    """Star edges between the sets of a bucket that share a content, from that with the smallest name; documents and edges unpacked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] >= buckets:
            read = lambda kind, width: np.frombuffer(b"".join(b[1:] for b in rows["blob"] if b[:1] == kind), "<i8").reshape(-1, width)
            docs, pairs = read(DOCS, 6), read(EDGES, 2)
            one = pd.DataFrame({"n": docs[:, 0], "doc_id": docs[:, 2], "key": docs[:, 3], "h1": docs[:, 4], "h2": docs[:, 5]}).astype("Int64")
            one.loc[docs[:, 1] == 0, "doc_id"] = pd.NA
            return pd.concat([_shaped(one), _shaped(pd.DataFrame(pairs, columns=["h1", "g1"]))], ignore_index=True)
        names, owners, values, base = [], [], [], 0
        for blob in rows["blob"]:
            n = int.from_bytes(blob[:4], "little")
            count = (len(blob) - 4 - 8 * n) // (2 + VALUE)
            names.append(np.frombuffer(blob, "<i8", n, 4))
            owners.append(np.frombuffer(blob, "<u2", count, 4 + 8 * n).astype(np.int64) + base)
            values.append(np.frombuffer(blob, np.uint8, VALUE * count, 4 + 8 * n + 2 * count).reshape(-1, VALUE))
            base += n
        name, rank = np.unique(np.concatenate(names), return_inverse=True)
        owner = rank[np.concatenate(owners)]
        value = np.zeros((len(owner), 8), np.uint8)
        value[:, :VALUE] = np.concatenate(values)
        value = value.view("<u8").ravel()
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        first = owner[new][np.cumsum(new) - 1]
        # owners are numbered, so a pair is one integer until it is known to be distinct
        tied = np.unique(first[~new] * len(name) + owner[~new])
        tied = tied[tied // len(name) != tied % len(name)]
        return _shaped(pd.DataFrame({"h1": name[tied // len(name)], "g1": name[tied % len(name)]}))

    return run


def _shaped(df: pd.DataFrame) -> pd.DataFrame:
    for c in (c.split()[0] for c in MET.split(", ")):
        df[c] = df[c].astype("Int64") if c in df else pd.array([None] * len(df), "Int64")
    return df[[c.split()[0] for c in MET.split(", ")]]


def _with_points(k: int, percent: int):
    """Points of candidate texts; rows whose text has another set (a repeated id and key) go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("ngram")
        for batch in batches:
            out = []
            for node, h1, h2, s in zip(batch["node"], batch["h1"], batch["h2"], shingle_sets(batch["text"].tolist(), k), strict=True):
                if set_identity(s) == (h1, h2):
                    out.append((node, len(s), point_of(s, percent)))
            yield pd.DataFrame(out, columns=["node", "n", "point"])
        trim()

    return run


def _bounded(percent: int):
    """Of candidate pairs those whose points allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("ngram")
        for batch in batches:
            ok = [may_link(read_point(p, n), read_point(q, m), percent) for p, n, q, m in zip(batch["point_a"], batch["n_a"], batch["point_b"], batch["n_b"], strict=True)]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _links(k: int, percent: int):
    """Of candidate pairs with their texts those whose whole sets link; a set is made once in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("ngram")
        for batch in batches:
            texts = dict(zip(batch["a"], batch["text_a"], strict=True)) | dict(zip(batch["b"], batch["text_b"], strict=True))
            sets = dict(zip(texts, shingle_sets(list(texts.values()), k), strict=True))
            ok = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(ok, bool), ["a", "b"]]
        trim()

    return run


TILES = "tile long, cluster long, cell long, nodes binary, labels binary, sizes binary, points binary, high array<int>, least long, a long, b long, more boolean"
NEAR = "a long, b long, more boolean"


class Tile:
    """Sets of a tile by size and coarse point: their nodes, parts (labels), sizes and points."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, points: list[np.ndarray]):
        self.nodes, self.labels, self.sizes, self.points = nodes, labels, sizes, points
        self.coarse = np.array([fold(p, COARSE) for p in points], np.int32).reshape(-1, COARSE)

    @classmethod
    def of(cls, group: pd.DataFrame) -> Tile:
        points = [read_point(p, n) for p, n in zip(group["point"], group["n"], strict=True)]
        t = cls(group["node"].to_numpy(np.int64), group["label"].to_numpy(np.int64), group["n"].to_numpy(np.int64), points)
        order = np.lexsort((*t.coarse.T[:4], t.sizes))
        return cls(t.nodes[order], t.labels[order], t.sizes[order], [points[i] for i in order])

    @classmethod
    def read(cls, nodes: bytes, labels: bytes, sizes: bytes, points: bytes) -> Tile:
        n = np.frombuffer(sizes, "<i8").reshape(2, -1)
        cut = np.concatenate([[0], np.cumsum(n[1])]).tolist()
        return cls(np.frombuffer(nodes, "<i8"), np.frombuffer(labels, "<i8"), n[0], [read_point(points[a:b], s) for a, b, s in zip(cut[:-1], cut[1:], n[0].tolist(), strict=True)])

    def row(self, cluster: int, cell: int) -> tuple:
        sizes = np.stack([self.sizes, [p.nbytes for p in self.points]])
        return (
            int(self.nodes.min()), cluster, cell, self.nodes.astype("<i8").tobytes(), self.labels.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(),
            b"".join(p.tobytes() for p in self.points), self.coarse.max(0).tolist(), int(self.sizes.min()), None, None, None,
        )

    def by_groups(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Row numbers and points of the sets with one number of groups."""
        groups = np.array([len(p) for p in self.points])
        return {int(g): (at := np.nonzero(groups == g)[0], np.array([self.points[i] for i in at])) for g in np.unique(groups)}


def near_pairs(x: Tile, y: Tile, percent: int, width: int) -> list[tuple[int, int, bool]]:
    """Pairs of sets of different parts whose points allow a link: (node, node, whether the first has more than these).

    Boxes of leaves bound the overlap first, then coarse points, then fine ones.
    A set names at most width partners in y.
    """
    minima = lambda a, b: sum(np.minimum(a[:, None, k], b[None, :, k]) for k in range(COARSE))
    at, bt = np.arange(0, len(x.nodes), LEAF), np.arange(0, len(y.nodes), LEAF)
    leaf = minima(np.maximum.reduceat(x.coarse, at), np.maximum.reduceat(y.coarse, bt)) >= needed(np.minimum.reduceat(x.sizes, at)[:, None] + np.minimum.reduceat(y.sizes, bt)[None, :], percent)
    fine, where = y.by_groups(), np.zeros(len(y.nodes), int)
    for rows, _ in fine.values():
        where[rows] = np.arange(len(rows))
    groups = np.array([len(p) for p in y.points])
    out = []
    for la in np.nonzero(leaf.any(1))[0]:
        columns = np.concatenate([np.arange(s, min(s + LEAF, len(y.nodes))) for s in bt[leaf[la]]])
        rows = np.arange(at[la], min(at[la] + LEAF, len(x.nodes)))
        near = minima(x.coarse[rows], y.coarse[columns]) >= needed(x.sizes[rows][:, None] + y.sizes[columns][None, :], percent)
        near &= x.labels[rows][:, None] != y.labels[columns][None, :]
        if x is y:
            near &= rows[:, None] < columns[None, :]
        for i, ok in zip(rows.tolist(), near, strict=True):
            js, found = columns[ok], 0
            for g in np.unique(groups[js]).tolist():
                both = min(g, len(x.points[i]))
                same = js[groups[js] == g]
                for s in range(0, len(same), max(1, (1 << 20) // g)):
                    part = same[s : s + max(1, (1 << 20) // g)]
                    bound = np.minimum(fold(x.points[i], both), fold(fine[g][1][where[part]], both)).sum(1)
                    for j in part[bound >= needed(x.sizes[i] + y.sizes[part], percent)].tolist():
                        found += 1
                        if found <= width:
                            out.append((int(x.nodes[i]), int(y.nodes[j]), False))
            if found > width:
                out[-1] = (*out[-1][:2], True)
    return out


def _tiles(percent: int, width: int):
    """Rows of the tiles of a group, and the pairs near each other inside each tile."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cluster, cell), group in rows.groupby(["cluster", "cell"]):  # one, but for keys that agree by chance
            tile = Tile.of(group)
            out += [tile.row(int(cluster), int(cell)), *[(None,) * 9 + e for e in near_pairs(tile, tile, percent, width)]]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TILES.split(", ")]).astype({c: "Int64" for c in ("tile", "cluster", "cell", "least", "a", "b")} | {"more": "boolean"})

    return run


def _across(percent: int, width: int):
    """The pairs near each other in two tiles."""

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        r = next(pair.itertuples(index=False))
        x, y = Tile.read(r.nodes, r.labels, r.sizes, r.points), Tile.read(r.nodes_b, r.labels_b, r.sizes_b, r.points_b)
        return pd.DataFrame(near_pairs(x, y, percent, width), columns=["a", "b", "more"])

    return run


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, after lower-casing A-Z; a
    document's set holds its distinct k-word shingles, or its whole sequence
    where it has fewer words. Two documents link when 100 times their common
    shingles reach percent (60 to 100) times the shingles of either.
    component_id is the smallest id that links reach. Documents without words
    link with nothing.

    No link between different texts is lost and none below the threshold made:
    candidates are complete (see the module), each is verified on the whole
    sets, and equal sets are one throughout. Components, not pairs, are
    returned; no stage emits the pairs of a group. Null texts count as empty.
    Ids are cast to long; null ones take part and never name a component that
    has another id. Rows that repeat an id are separate documents. Extra columns
    are ignored; an empty table gives an empty result.
    """
    Levels(percent)
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    letters = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(letters / 5 * 1.3 * differ(200, percent) / 100 / CONTENTS))
    rows = own.mapInPandas(_first_pass(k, percent, buckets), PASS).groupBy("bucket").applyInPandas(_meet(buckets), MET)
    rows = materialise(rows, "ngram-pass")
    found = rows.where("n is not null").select("doc_id", "n", "h1", "h2")
    # the text of a set is that of one row, looked up by id and text hash: null ids do not meet each other at large
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    reps = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), first.alias("row"))
    reps = materialise(reps.select("h1", "h2", "rep", F.col("row.doc_id").alias("row_id"), F.col("row.key").alias("row_key"), F.monotonically_increasing_id().alias("node")), "ngram-sets")
    edges = rows.where("n is null").select("h1", "g1").distinct()
    edges = edges.join(reps.select("h1", F.col("node").alias("x")), "h1").join(reps.select(F.col("h1").alias("g1"), F.col("node").alias("y")), "g1")
    edges = materialise(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ngram-candidates")
    components = connected_components(_verified(own, reps, edges, k, percent))
    named = reps.join(components, "node").groupBy("component").agg(F.min("rep").alias("low"))
    names = components.join(named, "component").select(F.col("node").alias("m"), "low")
    sets = reps.join(names, F.col("node") == F.col("m"), "left").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.coalesce("low", "rep").alias("low"))
    out = found.join(sets, (F.col("n") > 0) & (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def _texts(own: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, h1, h2, text: the text of the row that stands for each set; rows that repeat an id and a text give it again."""
    wanted = reps.join(nodes, "node").select("node", "h1", "h2", "row_id", "row_key")
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return own.join(wanted, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("key") == F.col("row_key"))).select("node", "h1", "h2", "text")


def _check(own: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets link."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialise(_texts(own, reps, nodes).dropDuplicates(["node"]).select("node", "text"), "ngram-texts")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    links = materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(_links(k, percent), "a long, b long"), "ngram-links")
    discard(texts)
    return links


def _verified(own: DataFrame, reps: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links a, b that span the components of all links.

    Sets that candidates connect are a cluster; all links lie inside clusters.
    Star edges are bounded and verified first. Clusters of three sets or more
    that verified links leave in parts are tiled: sets of different parts meet
    where their boxes and points allow a link. A set names a bounded number of
    partners in a pair of tiles; as long as any has more, the parts are joined
    by the links found and the rest goes through again with a larger bound.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    points = materialise(_texts(own, reps, nodes).mapInPandas(_with_points(k, percent), "node long, n long, point binary").dropDuplicates(["node"]), "ngram-points")
    side = lambda x: points.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}"))
    star = materialise(edges.join(side("a"), "a").join(side("b"), "b").mapInPandas(_bounded(percent), "a long, b long"), "ngram-star")
    links = _check(own, reps, star, k, percent)
    discard(star)
    cluster = connected_components(edges).withColumnRenamed("component", "cluster")
    discard(edges)
    width = WIDTH
    while True:
        pairs = _near(cluster, points, connected_components(links), percent, width)
        if pairs is None:
            discard(points)
            return links
        links = links.unionByName(_check(own, reps, pairs.select("a", "b"), k, percent))
        if pairs.where("more").isEmpty():
            discard(pairs, points)
            return links
        discard(pairs)
        width *= 8


def _near(cluster: DataFrame, points: DataFrame, components: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Pairs a, b of sets of different parts of a cluster whose points allow a link, and more; None where every cluster is one part."""
    state = cluster.join(components, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("label"))
    state = materialise(state, "ngram-labels")
    # two sets of a cluster of two have met already
    open_ = state.groupBy("cluster").agg(F.count("*").alias("members"), F.min("label").alias("x"), F.max("label").alias("y")).where("members > 2 and x < y").select("cluster")
    step = math.log(100 / percent) / 4  # sizes in quarter steps of the ratio that linked sizes may have
    left = state.join(open_, "cluster").join(points, "node").withColumn("cell", F.floor(F.log("n") / step)) if percent < 100 else state.where("false")
    if left.isEmpty():
        discard(state)
        return None
    left = materialise(left, "ngram-open")
    tiled = lambda *keys: left.groupBy(*keys).agg(F.greatest(F.least(F.ceil(F.count("*") / min(SMALL_TILE, TILE)), F.greatest(F.lit(8), F.ceil(F.count("*") / TILE))), F.ceil(F.sum(F.octet_length("point")) / TILE_BYTES)).alias("cuts"))
    whole = tiled("cluster").where("cuts = 1").select("cluster", F.lit(True).alias("whole"))
    left = left.join(whole, "cluster", "left").join(tiled("cluster", "cell"), ["cluster", "cell"])
    cell = F.when(F.col("whole"), F.lit(-10)).otherwise(F.col("cell"))  # a cluster that fits is one tile
    cut = F.when(F.col("whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("cuts")))
    left = left.select("cluster", "node", "label", "n", "point", cell.cast("long").alias("cell"), cut.alias("cut"))
    # one key for each tile, so that the tiles of a cluster go to many tasks
    left = left.withColumn("key", F.xxhash64("cluster", "cell", "cut")).drop("cut")
    tiles = materialise(left.groupBy("key").applyInPandas(_tiles(percent, width), TILES), "ngram-tiles")
    inside = tiles.where("a is not null").select("a", "b", "more")
    tiles_only = tiles.where("a is null and cell <> -10")
    brief = tiles_only.select("tile", "cluster", "cell", "high", "least")
    near = brief.select("cluster", F.explode(F.sequence(F.col("cell") - 5, F.col("cell") + 5)).alias("cell"), F.col("tile").alias("tile_b"), F.col("high").alias("high_b"), F.col("least").alias("least_b"))
    bound = F.aggregate(F.zip_with("high", "high_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    least = F.ceil((F.col("least") + F.col("least_b")) * percent / (100 + percent))
    pairs = brief.join(near, ["cluster", "cell"]).where("tile < tile_b").where(bound >= least).select("tile", "tile_b")
    parts = ["nodes", "labels", "sizes", "points"]
    full = pairs.join(tiles_only.select("tile", *parts), "tile").join(tiles_only.select(F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in parts]), "tile_b")
    full = full.withColumn("pair", F.xxhash64("tile", "tile_b"))
    across = full.groupBy("pair", "tile", "tile_b").applyInPandas(_across(percent, width), NEAR)
    out = materialise(inside.unionByName(across), "ngram-near")
    discard(tiles, state)
    return out
