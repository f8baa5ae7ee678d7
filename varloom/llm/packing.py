"""Best-fit packing of token sequences, planned over a histogram of lengths."""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import materialise, small_batches, worker_state

#: Chunks of text whose ids a Python worker remembers, twice over at most, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
#: White space at which every text may be cut for the tokenizer; Python's own split also cuts at these separators, which the tokenizer keeps.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile("[\x20\x09-\x0d]+")
#: Chunks of these characters are normalised by lower-casing alone and parted by WORDS; all others, and any that may hold a special token, go through the whole tokenizer.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PIECES = "piece int, start long, length long, ids_crc32 long"


class ChunkIds:
    """Ids of texts, put together from those of their chunks between white space; a chunk's ids do not depend on its neighbours.

    What is remembered is kept in two halves: when the newer is full it becomes
    the older, whose entries come back as they are met again.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {k: as_bytes.pre_tokenize_str(chr(k))[0][0] for k in range(0xDF, 0x100) if k != 0xF7}
        self.known: dict[str, bytes] = _Known(self)
        self.older: dict[str, bytes] = {}

    def of_text(self, text: str) -> bytes:
        chunks = BLANKS.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, chunks))

    def of_chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            parts = WORDS.findall(chunk.lower())
            ids = [t.id for part in parts for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    def __init__(self, owner: ChunkIds):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        owner = self.owner
        ids = owner.older.get(chunk)
        if ids is None:
            ids = owner.of_chunk(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                owner.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids_crc32 of each document's ids (end id 0 included) cut every size tokens.

    The tokenizer's normaliser and splitter work between white space, so a text
    is encoded chunk by chunk, and a worker remembers what the chunks gave.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: ChunkIds = worker_state(("packing", tokenizer_path), lambda: ChunkIds(tokenizer_path))
        step = 4 * size
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                ids = known.of_text(text or "") + b"\0\0\0\0"
                out += [(key, at // step, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    # ids travel as text, so ids of any type, and null, come back as they were
    kind = docs.schema[id_col].dataType
    pieces = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, f"id string, {PIECES}")
    return pieces.withColumn("id", F.col("id").cast(kind))


def plan(counts: Iterable[tuple[int, int]], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit, longest first, over counts of lengths: (length, first rank, items, sequences, first sequence, offset) and the number of sequences.

    Items of a slot go round its sequences; each round lies one length further on.
    Sequences that hold the same lengths are one group. Items of a length fill
    the group with the least room that fits, else new sequences. What it costs
    depends on the number of different lengths, at most size, not on the number
    of items.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, number), a heap
    free: list[int] = []  # rooms that have groups, in order
    slots, used = [], 0
    for length, n in sorted(counts, reverse=True):
        rank = 0
        while rank < n:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, many = heapq.heappop(rooms[room])
                if not rooms[room]:
                    del rooms[room], free[at]
            else:  # new sequences, as many as this length fills
                room, first, many = size, used, -(-(n - rank) // (size // length))
                used += many
            each = room // length  # a sequence is filled before the next one of like room
            take = min(many, (n - rank) // each)
            if not take:
                take, each = 1, n - rank
            slots.append((length, rank, take * each, take, first, size - room))
            rank += take * each
            for left, start, number in ((room - each * length, first, take), (room, first + take, many - take)):
                if number and left:
                    if left not in rooms:
                        rooms[left] = []
                        insort(free, left)
                    heapq.heappush(rooms[left], (start, number))
    return slots, used


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a length from 1 to size.

    Only the histogram, at most size rows, comes to the driver. A piece's rank
    within its length is its place in a share of that length, dealt by a hash, on
    top of what the shares before hold; so a length that a third of all pieces
    have is ranked by many tasks. Each share takes the planned slots that its
    ranks meet.
    """
    spark = pieces.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in pieces.columns if c != "length"]
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64(*order), F.lit(deal)).cast("int"))
    shares = materialise(dealt.groupBy("length", "share").agg(F.count("*").alias("n")), "packing-shares")
    counts = [(r["length"], r["n"]) for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()]  # one row for each length, at most size
    slots, _ = plan(counts, size)
    planned = spark.createDataFrame(slots or [(0, 0, 0, 0, 0, 0)], "length long, first long, many long, over long, sequence long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.withColumn("base", F.coalesce(before, F.lit(0)))
    # slots are as few as lengths and rooms allow, whatever the number of pieces
    met = shares.join(F.broadcast(planned), "length").where("first < base + n and base < first + many")
    met = met.groupBy("length", "share", "base").agg(F.collect_list(F.struct("first", "many", "over", "sequence", "offset")).alias("slots"))
    place = F.row_number().over(Window.partitionBy("length", "share").orderBy(*order))
    ranked = dealt.withColumn("place", place).join(met, ["length", "share"])
    rank = F.col("base") + F.col("place") - 1
    slot = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["many"])), F.lit(0))
    out = ranked.withColumn("rank", rank).withColumn("slot", slot)
    along = F.col("rank") - F.col("slot.first")
    sequence, offset = F.col("slot.sequence") + along % F.col("slot.over"), F.col("slot.offset") + F.expr("(rank - slot.first) div slot.over") * F.col("length")
    return out.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id 0; one longer than size is cut into
    pieces of size tokens, of which the last may be shorter. Pieces are packed,
    longest first, each into the fullest sequence that has room. In a sequence
    offsets follow each other without gaps from 0.

    A null or empty text is the end id alone: one piece of length 1. Rows that
    repeat an id, and rows whose id is null, are documents of their own; rows
    alike in every way get places of their own. Extra columns are ignored; an
    empty table gives an empty result.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, size, id_col, text_col), "packing-pieces")
    return pack(pieces, size).withColumnRenamed("id", id_col)
