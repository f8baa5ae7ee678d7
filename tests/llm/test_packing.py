"""Best-fit packing against the tokenizer and against best fit over single pieces."""

import random
import struct
import zlib

import public_tokenizers
import pytest

from varloom.llm.packing import ChunkIds, best_fit_packing, plan

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def chunks():
    return ChunkIds(TOKENIZER)


def library(chunks, text):
    return chunks.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(chunks):
    rng = random.Random(2)
    alphabet = [chr(k) for k in (*range(0x21, 0x7F), *range(0xA0, 0x100))] + [*"́̈ΣİĞﬁ각　\x1c\x1f\x85\x00😀 \n\t", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "don't"]
    texts = ["", " ", "한", "a\x1cb", *["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(4000)]]
    for text in texts:
        ids = library(chunks, text)
        assert chunks.of_text(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def best_fit(lengths, size):
    """Rooms left when each length, longest first, goes where the least room is left."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms[rooms.index(min(fits))] -= length
        else:
            rooms.append(size - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 32, 64])
    counts = {k: rng.randint(1, rng.choice([1, 9, 60])) for k in range(1, size + 1) if rng.random() < 0.6}
    slots, used = plan(counts.items(), size)
    lengths = [k for k, n in counts.items() for _ in range(n)]
    taken, ranks = {}, set()
    for length, first, n, over, sequence, offset in slots:
        for k in range(n):
            ranks.add((length, first + k))
            taken.setdefault(sequence + k % over, []).append((offset + k // over * length, length))
    assert ranks == {(k, r) for k, n in counts.items() for r in range(n)}
    assert sorted(taken) == list(range(used))
    rooms = []
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
        rooms.append(size - at)
    assert sorted(rooms) == best_fit(lengths, size)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    counts = [(k, rng.randint(1, 100)) for k in range(1, 2049)]
    small, _ = plan(counts, 2048)
    large, used = plan([(k, n * 10**6) for k, n in counts], 2048)
    assert len(large) < 2 * len(small) + 4096 and used >= sum(k * n for k, n in counts) * 10**6 // 2048


def packed(spark, rows, schema="doc_id long, text string", size=8):
    return best_fit_packing(spark.createDataFrame(rows, schema), TOKENIZER, size).collect()


def test_packing_of_documents(spark, chunks):
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gámma", "x" * 70, "don't", "7", "—"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    rows += [(1000 + k, "same text") for k in range(150)] + [(2000, None), (2001, ""), (2002, " \n "), (None, "alpha"), (7, "again"), (7, "again"), (3000, "word " * 5000)]
    got = packed(spark, rows)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by_sequence, expected, lengths = {}, [], []
    for key, text in rows:
        ids = [*library(chunks, text or ""), 0]
        for piece, at in enumerate(range(0, len(ids), 8)):
            part = ids[at : at + 8]
            expected.append((key, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            lengths.append(len(part))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 8
    assert len(by_sequence) == len(best_fit(lengths, 8))


def test_empty_and_extra_columns(spark):
    assert packed(spark, []) == []
    extra = "doc_id string, text string, length int, share string, slots int, piece int, id long"
    got = packed(spark, [("a", None, 1, "s", 2, 3, 4), ("b", "x", None, None, None, None, None)], extra)
    assert sorted((r["doc_id"], r["length"]) for r in got) == [("a", 1), ("b", 2)]
    assert [len(r) for r in got] == [7, 7]
