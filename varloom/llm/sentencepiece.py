"""SentencePiece encoding by suffix-array matching, and decoding.

For models of the unigram or BPE kind with byte fallback whose normaliser
changes nothing but blanks; others are refused. All pieces' occurrences in a
batch's words come from one suffix array; the edges, sorted by position, are
relaxed to the best sum of scores, or to the one segmentation that BPE makes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import filterfalse, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import small_batches, trim, worker_state

BLANK = "▁"
#: Characters of a batch's distinct words that one suffix array indexes.
INDEX_CHARS = 200_000
#: Distinct words and pair checks a worker remembers before it starts anew.
MEMORY = 400_000
#: Words seen once that are remembered, so that those which come again after many others are not learned anew.
ONCE = 300_000
#: Characters of a batch that are cut into words at once; a longer text is taken alone.
SLICE_CHARS = 2_000_000

#: Letters from which a word is relaxed by itself.
LONG = 64
#: Larger than any piece number or code point; marks a position that no piece has reached.
CODES, NONE = 1 << 22, -(1 << 40)

CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


#: Fixed values of the model format: piece types, model types, and the penalty of a character without a piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces and scores of a model file; small, and sent to workers whole."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], skipped: set[int], kind: int = BPE):
        self.pieces, self.scores, self.bytes, self.skipped, self.kind = pieces, scores, bytes_, skipped, kind

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file; ValueError for one whose texts would be cut otherwise than here."""
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, types = [], [], []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b"").decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                types.append(one.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        wrong = {
            "its type is neither BPE nor unigram": kind not in (BPE, UNIGRAM),
            "it has no byte fallback": not trainer.get(35, 0) or types.count(BYTE) != 256,
            "blanks end its pieces": bool(trainer.get(24, 0)),
            "its normaliser changes characters": bool(normalizer.get(2, b"")),
            "it puts no blank in front": not normalizer.get(3, 1),
            "it removes blanks": bool(normalizer.get(4, 1)),
            "it does not write blanks as U+2581": not normalizer.get(5, 1),
            "it has symbols of its user": USER_DEFINED in types,
            "pieces go on after a blank": any(BLANK in p.lstrip(BLANK) for p, t in zip(pieces, types, strict=True) if t == NORMAL),
        }
        for what, is_so in wrong.items():
            if is_so:
                raise ValueError(f"model not supported: {what}")
        coded = {i: int(pieces[i][3:5], 16) for i, t in enumerate(types) if t == BYTE}
        skipped = {i for i, t in enumerate(types) if t in (UNKNOWN, CONTROL, UNUSED)} | coded.keys()
        return cls(pieces, scores, coded, skipped, kind)


class Codec:
    """Encoder and decoder of one worker, with what it has learned about words so far."""

    def __init__(self, model: PieceModel):
        self.ids = {p: i for i, p in enumerate(model.pieces) if i not in model.skipped}
        self.pieces, self.scores, self.sums = model.pieces, model.scores, model.kind == UNIGRAM
        self.unknown = min((model.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.width = max(map(len, self.ids))
        self.separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in p for p in self.ids))
        self.byte_ids = {b: i for i, b in model.bytes.items()}
        self.raw = [bytes([model.bytes[i]]) if i in model.bytes else b"" if i in model.skipped else p.encode() for i, p in enumerate(model.pieces)]
        names = sorted(self.ids)
        self.names, self.lengths = np.array(names, dtype=f"U{self.width}"), np.array([len(p) for p in names])
        self.numbers = np.array([self.ids[p] for p in names])
        self.last = np.array([p + chr(0x10FFFF) * (self.width - len(p)) for p in names], dtype=f"U{self.width}")
        # a line feed that no piece holds parts a text: nothing is joined across it
        self.parts_lines = not any("\n" in p for p in self.ids)
        self.line_end = np.array(self._unknown("\n"), np.int32).tobytes()
        # ids of words, four bytes each
        self.words: dict[str, bytes] = {}  # with the blank in front, which the key leaves out
        self.starts: dict[str, bytes] = {}  # without one
        # words of one slice so far; most never come again, and need not push out those that do
        self.once: dict[str, bytes] = {}
        self.one: dict[tuple[int, int], bool] = {}
        self.pairs, self.fits = np.array([-1], np.int64), np.zeros(1, bool)

    def _unknown(self, letter: str) -> list[int]:
        return [self.byte_ids.get(b, 0) for b in letter.encode("utf-8", "replace")]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: join the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, piece: int) -> str:
        """A piece, a character without one (below -1), or nothing (-1)."""
        return self.pieces[piece] if piece >= 0 else "" if piece == -1 else chr(-piece - 2)

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps right behind left: it does in a text when it does for every two neighbours.

        Answers are remembered as a sorted table of pair codes.
        """
        codes, where = np.unique((left + CODES) * CODES + right, return_inverse=True)
        at = np.searchsorted(self.pairs, codes)
        known = (at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == codes)
        answer = np.zeros(len(codes), bool)
        answer[known] = self.fits[at[known]]
        if not known.all():
            new = codes[~known]
            found = np.array([self.merged(a + b) == ([a, b] if a else [b]) for a, b in ((self._name(int(c // CODES - CODES)), self._name(int(c % CODES))) for c in new)], bool)
            answer[~known] = found
            if len(self.pairs) > 4 * MEMORY:
                self.pairs, self.fits = self.pairs[:1], self.fits[:1]
            pairs, fits = np.concatenate([self.pairs, new]), np.concatenate([self.fits, found])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], fits[order]
        return answer[where]

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of every piece, sorted by end, longest first.

        Works in slices of INDEX_CHARS that overlap by a piece's width, so its
        memory does not grow with the text.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts, sizes, pieces = [], [], []
        for s in range(0, len(codes), INDEX_CHARS):
            part = codes[s : s + INDEX_CHARS + self.width - 1]
            n = min(INDEX_CHARS, len(codes) - s)
            padded = np.concatenate([part, np.zeros(self.width, np.uint32)])
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[:n]).view(f"<U{self.width}").ravel()
            order = np.argsort(windows, kind="stable")
            suffixes = windows[order]
            low, high = np.searchsorted(suffixes, self.names, "left"), np.searchsorted(suffixes, self.last, "right")
            count = high - low
            hit = np.nonzero(count)[0]
            count = count[hit]
            ranges = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            starts.append(order[ranges] + s), sizes.append(np.repeat(self.lengths[hit], count)), pieces.append(np.repeat(self.numbers[hit], count))
        start, size, piece = (np.concatenate(x).astype(np.int64) for x in (starts, sizes, pieces))
        by_end = np.lexsort((start, start + size))
        return start[by_end], (start + size)[by_end], piece[by_end]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, from the edges of all of them together, relaxed position by position in all words at once."""
        text = self.separator.join(words)
        lengths = np.array([len(w) for w in words])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        start, end, piece = self.edges(text) if text else (np.zeros(0, np.int64),) * 3
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        owner = np.searchsorted(begins, start, "right") - 1
        step = end - begins[owner]
        # an edge that reaches over a word's end belongs to none
        fits = step <= lengths[owner]
        start, end, piece, step = start[fits], end[fits], piece[fits], step[fits]
        order = np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last = np.full(len(text) + 1, NONE, np.int64)  # the piece that ends at each position
        last[begins] = -1
        longest = int(lengths.max(initial=0))
        bounds = np.searchsorted(step, np.arange(1, longest + 2))
        by_length = np.argsort(-lengths, kind="stable")
        still = np.searchsorted(-lengths[by_length], -np.arange(1, longest + 1), "right")
        for t in range(1, longest + 1):
            lo, hi = bounds[t - 1], bounds[t]
            ok = self._fitting(last[start[lo:hi]], piece[lo:hi]) if hi > lo else np.zeros(0, bool)
            last[end[lo:hi][ok]] = piece[lo:hi][ok]
            here = begins[by_length[: still[t - 1]]] + t
            here = here[last[here] == NONE]
            last[here] = -2 - letters[here - 1]  # characters without a piece
        at, live, found = begins + lengths, np.nonzero(lengths)[0], []
        sizes = np.array([len(p) for p in self.pieces])
        while len(live):
            p = last[at[live]]
            found.append((live, p))
            at[live] -= np.where(p >= 0, sizes[np.maximum(p, 0)], 1)
            live = live[at[live] > begins[live]]
        if not found:
            return [b"" for _ in words]
        owner = np.concatenate([w for w, _ in found][::-1])
        ids = np.concatenate([p for _, p in found][::-1])
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        plain, strange = ids.astype(np.int32).tobytes(), set(owner[ids < 0].tolist())
        out = [plain[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for w in strange:
            out[w] = np.array([x for p in ids[cuts[w] : cuts[w + 1]].tolist() for x in ([p] if p >= 0 else self._unknown(chr(-p - 2)))], np.int32).tobytes()
        return out

    def learn_long(self, word: str) -> bytes:
        """Ids of one long word, relaxed edge by edge: positions are many and words one."""
        start, end, piece = (x.tolist() for x in self.edges(word))
        last = [NONE] * (len(word) + 1)
        last[0], known = -1, self.one
        if len(known) > MEMORY:
            known.clear()
        at = 0
        for j in range(1, len(word) + 1):
            while at < len(end) and end[at] == j:
                if last[j] == NONE:
                    pair = last[start[at]], piece[at]
                    ok = known.get(pair)
                    if ok is None:
                        a, b = self._name(pair[0]), self._name(pair[1])
                        ok = known[pair] = self.merged(a + b) == ([a, b] if a else [b])
                    if ok:
                        last[j] = piece[at]
                at += 1
            if last[j] == NONE:
                last[j] = -2 - ord(word[j - 1])
        out, j = [], len(word)
        while j:
            p = last[j]
            out.append([p] if p >= 0 else self._unknown(chr(-p - 2)))
            j -= len(self.pieces[p]) if p >= 0 else 1
        return np.array([x for ids in reversed(out) for x in ids], np.int32).tobytes()

    def learn_sums(self, words: list[str]) -> list[bytes]:
        """Ids of words by the best sum of scores; of equal sums that whose last piece is longest.

        The library adds up whole texts in single precision, so among equal sums
        it may choose otherwise.
        """
        scores, unknown = self.scores, self.unknown
        start, end, piece = self.edges(self.separator.join(words))
        begin, at, out = 0, 0, []
        start, end, piece = start.tolist(), end.tolist(), piece.tolist()
        for word in words:
            best: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # sum, start and piece of the edge that ends here
            for j in range(1, len(word) + 1):
                found, single = None, False
                while at < len(end) and end[at] <= begin + j:
                    i = start[at] - begin
                    if end[at] == begin + j and i >= 0:
                        single |= i == j - 1
                        score = best[i][0] + scores[piece[at]]
                        if found is None or score > found[0]:
                            found = score, i, piece[at]
                    at += 1
                if not single and (found is None or best[j - 1][0] + unknown > found[0]):
                    found = best[j - 1][0] + unknown, j - 1, -2
                best.append(found)
            ids, j = [], len(word)
            while j:
                _, i, p = best[j]
                ids.append([p] if p >= 0 else self._unknown(word[i]))
                j = i
            out.append(np.array([x for part in reversed(ids) for x in part], np.int32).tobytes())
            begin += len(word) + 1
        return out

    def _learn_all(self, known: dict[str, bytes], new: set[str], blank: str) -> None:
        batch, size, learn = [], 0, self.learn_sums if self.sums else self.learn
        for word in sorted(new):
            if len(word) > LONG and not self.sums:
                known[word] = self.learn_long(blank + word)
                continue
            batch.append(word)
            size += len(word) + 2
            if size >= INDEX_CHARS:
                known.update(zip(batch, learn([blank + w for w in batch]), strict=True))
                batch, size = [], 0
        if batch:
            known.update(zip(batch, learn([blank + w for w in batch]), strict=True))

    def cut(self, text: str) -> list[tuple[str | None, list[str]]]:
        """Lines as (beginning without a blank in front, words with one); a null beginning at a text that starts with one."""
        out = []
        for k, line in enumerate(text.split("\n") if self.parts_lines else [text]):
            if "  " in line or BLANK in line or line[:1] == " " or line[-1:] == " ":
                # runs of blanks go with the word behind them
                chunks = CHUNK.findall(("" if k else BLANK) + line.replace(" ", BLANK))
                first = chunks.pop(0) if k and chunks and chunks[0][0] != BLANK else None
                out.append((first, [c[1:] for c in chunks]))
            else:
                words = line.split(" ")
                out.append((None, words) if not k else (words[0] or None, words[1:]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, part, size = [], [], 0
        for text in texts:
            if part and size + len(text) > SLICE_CHARS:
                out += self._encode(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        out += self._encode(part)
        trim()  # what the arrays of a batch leave between the words that stay
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) if t else [] for t in texts]
        for known, most in ((self.words, MEMORY), (self.starts, MEMORY), (self.once, ONCE)):
            if len(known) > most:  # the oldest go
                for word in list(islice(known, len(known) - most // 2)):
                    del known[word]
        words: set[str] = set()
        firsts: set[str] = set()
        for lines in cut:
            for first, ws in lines:
                words.update(filterfalse(self.words.__contains__, ws))
                if first and first not in self.starts:
                    firsts.add(first)
        again = words & self.once.keys()
        self.words.update((w, self.once.pop(w)) for w in again)
        words -= again
        self._learn_all(self.words, words, BLANK)
        self._learn_all(self.starts, firsts, "")
        get, starts, out = self.words.__getitem__, self.starts, []
        for lines in cut:
            ids: list[bytes] = []
            for k, (first, ws) in enumerate(lines):
                if k:
                    ids.append(self.line_end)
                if first:
                    ids.append(starts[first])
                ids.extend(map(get, ws))
            out.append(np.frombuffer(b"".join(ids), dtype=np.int32))
        self.once.update((w, self.words.pop(w)) for w in words)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        top = len(self.raw)
        numbers = np.asarray(ids, dtype=np.int64)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= top):
            numbers = numbers[(numbers >= 0) & (numbers < top)]
        text = b"".join(map(self.raw.__getitem__, numbers.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def _codec(model: PieceModel) -> Codec:
    """The worker's codec of a model."""
    return worker_state(("sentencepiece", hash((tuple(model.pieces), tuple(model.scores)))), lambda: Codec(model))


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """The input's rows and columns plus token_ids (array of int) and n_tokens.

    Whole texts, in one pass without a shuffle. A null text gives a null array
    and null n_tokens, an empty one an empty array. A blank goes before the
    text; blanks and U+2581 are one symbol; characters without a piece become
    their UTF-8 bytes; names of control symbols in a text are ordinary text.
    Columns of the input named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(ids_col, "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the model file

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for texts in batches:
            known = texts.notna()
            found = iter(codec.encode(texts[known].tolist()))
            yield pd.Series([next(found) if k else None for k in known], dtype=object)

    return base.withColumn(ids_col, F.pandas_udf(encoded, T.ArrayType(T.IntegerType()))(text_col)).withColumn("n_tokens", F.when(F.col(ids_col).isNotNull(), F.size(ids_col)))


def decode(tokens: DataFrame, model: PieceModel, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """The input's rows and columns plus the text of their ids; the leading blank goes, ids outside the model and nulls are skipped."""
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for rows in batches:
            # an array with a null in it does not come as one of integers
            yield pd.Series([None if ids is None else codec.decode(ids if ids.dtype.kind == "i" else [int(i) for i in ids if i is not None and i == i]) for ids in rows], dtype=object)

    return tokens.drop(text_col).withColumn(text_col, F.pandas_udf(decoded, T.StringType())(ids_col))
