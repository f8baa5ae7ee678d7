"""Toxicity by noisy-channel deobfuscation and a learned score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import materialise, small_batches, trim, worker_state

#: Letters that a written character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts that look like these ones.
LEET |= dict(zip("аеорсхуіјѕԁһкмтвнαερτυνικο", "aeopcxyijsdhkmtbhaeptuviko", strict=True))
#: Log probabilities of the channel: a letter written as itself, as a look-alike, repeated, or with a mark put after it.
SAME, ALIKE, REPEAT, MARK = math.log(0.96), math.log(0.02), math.log(0.02), math.log(0.01)
LOST = math.log(0.0005)  # a look-alike that stands for nothing
PART = math.log(0.2)  # a word ends inside a spaced run, or at a sign inside a token
PREFIX = 5  # letters of a word's beginning that are judged like a word of their own

LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER = 27  # any other letter; 0 is the edge of a word
ALPHABET = 28

#: Three single characters in a row, with any white space between them: letters spaced out.
SPACED_HINT = re.compile(r"(?<!\S)\S\s++\S\s++\S(?!\S)")
SPACED_RUN = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
#: Runs of three and more pieces of one to three characters, parted by white space alone.
PIECES = re.compile(r"(?<!\S)[\w@$!|+(€£]{1,3}+(?:\s++[\w@$!|+(€£]{1,3}+(?=[\s.,;:!?]|\Z)){2,}+")
FOREIGN = re.compile("[" + "".join(c for c in LEET if c.isalpha()) + "]")
NUMBER = re.compile(r"[\d.,:/%+-]+")
SIGN = re.compile(r"[^\w]")
PARTING = re.compile("[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]+")
REPEATED = re.compile(r"([^\W\d_])\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
DRAWN = re.compile(r"(.)\1{3,}", re.DOTALL)
EDGES = ".,;:!?\"'()[]{}*#%&$@+-_=<>|/\\~^`"
STARTS, ENDS = set("$@!|+(€£¡"), set("$€£|@")
LONGEST = 32  # longer tokens are no word, and known words are looked for in them
SHORTEST = 3  # letters of the shortest word that is learned

CACHE = 300_000


class CharModel:
    """Character trigrams with backing off, as a table of log probabilities."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        uni = (tri.sum((0, 1)) + 1) / (tri.sum() + ALPHABET)
        bi = (tri.sum(0) + 5 * uni) / (tri.sum((0, 2))[:, None] + 5)
        self.log = np.log((tri + 5 * bi[None]) / (tri.sum(2)[:, :, None] + 5))
        self.rows = self.log.tolist()


def _code(letter: str) -> int:
    k = ord(letter) - 96
    return k if 1 <= k <= 26 else OTHER


def count_trigrams(texts: Iterator[str]) -> np.ndarray:
    """Trigram counts of the plain words of texts, edges of words included; drawn-out words teach nothing."""
    words: Counter[str] = Counter()
    for text in texts:
        words.update(w for w in text.lower().split() if w.isalpha())
    total = np.zeros(ALPHABET**3, np.int64)
    for word, n in words.items():
        if REPEATED.search(word):
            continue
        codes = [0, 0, *map(_code, word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            total[(a * ALPHABET + b) * ALPHABET + c] += n
    return total


class Restorer:
    """Viterbi decoding of one token's lattice under a character model; remembers tokens."""

    def __init__(self, model: CharModel, words: set[str] = frozenset()):
        self.rows, self.known, self.words = model.rows, {}, words
        self.lengths = sorted({len(w) for w in words})

    def restore(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[token] = self.decode(token)
        return found

    def parts(self, token: str) -> list[str]:
        """The likeliest words behind a token with signs in it, each sign a mark or the end of a word."""
        key = "/" + token
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self.search(token, signs=True)[1]
        return found.split()

    def joined(self, run: str) -> set[str]:
        """The known words that three or more whole pieces of a run make together, look-alikes restored."""
        pieces, out = run.split(), set()
        longest = self.lengths[-1] if self.lengths else 0
        for i in range(len(pieces) - 2):
            word = pieces[i] + pieces[i + 1]
            for piece in pieces[i + 2 :]:
                word += piece
                if len(word) > 2 * longest:
                    break
                if word.isalpha() and not FOREIGN.search(word):
                    if word in self.words:
                        out.add(word)
                elif not word.isdigit():
                    out.update({self.restore(word)} & self.words)
        return out

    def known_in(self, word: str, shortest: int = SHORTEST) -> set[str]:
        """The known words, of every length they have, that stand anywhere in a word."""
        return {word[i : i + n] for n in self.lengths if n >= shortest for i in range(len(word) - n + 1)} & self.words

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest letters behind a token; in a spaced run words are parted where that is likelier.

        States are the last two letters. A written letter is itself, a repeat of
        the letter before, or noise when it is a mark; a look-alike may also be
        one of its letters, or nothing. Paths are kept as links to the letter
        before, so memory grows with the token alone.
        """
        return self.search(token, spaced)[1]

    def search(self, token: str, spaced: bool = False, signs: bool = False) -> tuple[float, str]:
        """Log probability and letters of the best path through the whole lattice; no path is cut off."""
        rows = self.rows
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ch in token:
            letters = ch if ch.isalpha() else ""
            also = LEET.get(ch, "")
            drop = None if letters else LOST if also else MARK
            read = [(letters, SAME)] * bool(letters) + [(x, ALIKE) for x in also]
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                if drop is not None:
                    old = nxt.get((a, b))
                    if old is None or old[0] < score + drop:
                        nxt[a, b] = (score + drop, path)
                row = rows[a][b]
                for x, cost in read:
                    k = _code(x)
                    got = score + cost + row[k]
                    old = nxt.get((b, k))
                    if old is None or old[0] < got:
                        nxt[b, k] = (got, (path, x))
                    if path and path[1] == x:  # the same letter drawn out
                        got = score + REPEAT + (cost if x != ch else 0.0)
                        old = nxt.get((a, b))
                        if old is None or old[0] < got:
                            nxt[a, b] = (got, path)
            if spaced or signs and drop is not None:  # a word may end behind any letter, or at a sign
                ends = [(score + rows[a][b][0] + PART, path) for (a, b), (score, path) in nxt.items() if b]
                if ends:
                    score, path = max(ends, key=lambda e: e[0])
                    old = nxt.get((0, 0))
                    if old is None or old[0] < score:
                        nxt[0, 0] = (score, (path, " "))
            states = nxt
        best, path = max(((score + (rows[a][b][0] if b or not (spaced or signs) else 0.0), path) for (a, b), (score, path) in states.items()), key=lambda e: e[0], default=(0.0, None))
        text = []
        while path:
            path, x = path
            text.append(x)
        return best, "".join(reversed(text))


def _restored(core: str, restorer: Restorer) -> set[str]:
    """The likeliest reading of a whole token; for one longer than any word also the known words in it."""
    word = restorer.restore(DRAWN.sub(r"\1\1\1", core))
    return {word} if len(core) <= LONGEST else {word} | restorer.known_in(word, SHORTEST + 1)


def restored_words(text: str, restorer: Restorer) -> set[str]:
    """The distinct lower-case words of a whole text with disguises of spelling undone.

    A token of letters alone has one path through its lattice and stays as it
    is; only tokens with look-alikes, marks or repeated letters are decoded,
    beside their plain form, and runs of single characters as words without
    blanks between them. Look-alikes right in front of a token or behind it may
    be its letters. A sign inside a token is a mark in its word or parts two
    words. Tokens of digits and the signs of numbers are numbers. Three and more
    pieces of up to three characters make a word where it is a known one.
    """
    text = text.lower()
    tokens = set(text.split())
    out = {t for t in tokens if t.isalpha()}
    for token in tokens - out:
        core = token.strip(EDGES)
        i = len(token) - len(token.lstrip(EDGES)) if core else 0
        j = i + len(core)
        while i and token[i - 1] in STARTS:
            i -= 1
        while j < len(token) and token[j] in ENDS:
            j += 1
        wide = token[i:j]
        if core.isalpha():
            out.add(core)
            if wide == core:
                continue
        if wide and not NUMBER.fullmatch(wide):
            out |= _restored(wide, restorer)
            if SIGN.search(core):
                out.update(w for w in restorer.parts(DRAWN.sub(r"\1\1\1", core)) if len(w) >= SHORTEST)
                for piece in PARTING.split(core):
                    if len(piece) >= SHORTEST and not NUMBER.fullmatch(piece):
                        out |= _restored(piece, restorer)
    if FOREIGN.search(text):
        for token in [t for t in out if FOREIGN.search(t)]:
            out |= _restored(token, restorer)
    if DOUBLED.search(text):
        for token in [t for t in out if DOUBLED.search(t)]:
            out |= _restored(token, restorer)
    if SPACED_HINT.search(text):
        for run in SPACED_RUN.findall(text):
            letters = "".join(run.split())
            if NUMBER.fullmatch(letters):
                continue
            parted = restorer.decode(letters, spaced=True).split()
            out.update(w for w in parted if len(w) >= SHORTEST)
            out |= restorer.known_in("".join(parted))
            out |= _restored(letters, restorer)
    if restorer.words:
        for run in set(PIECES.findall(text)):
            out |= restorer.joined(run)
    out.discard("")
    return out


def _sum_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts over every whole text; each task sends one fixed-size table."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("toxicity")
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            total += count_trigrams(t for t in batch["t"] if t)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"k": at, "n": total[at]})
        trim()

    # at most ALPHABET ** 3 rows come back, whatever the input
    rows = docs.select(F.col(text).alias("t")).mapInPandas(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(ALPHABET**3, np.int64)
    for k, n in rows:
        table[k] = n
    return table


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class Model:
    """What scoring needs: character counts, word weights, and the final regression."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], coefficients: list[float]):
        self.counts, self.weights, self.coefficients = counts, weights, coefficients

    def restorer(self) -> Restorer:
        """Known words add a twentieth of the corpus to the character model, none over a hundredth, so that disguises of them are found."""
        counts = self.counts.copy()
        each = max(1, int(counts.sum()) // max(100, 20 * len(self.weights)))
        for word in self.weights:
            if word[0] == "^":
                continue
            codes = [0, 0, *map(_code, word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                counts[(a * ALPHABET + b) * ALPHABET + c] += each // len(codes) + 1
        return Restorer(CharModel(counts), {w for w in self.weights if w[0] != "^"})


def features(words: set[str], weights: dict[str, float]) -> list[float]:
    """Constant, distinct known words, sum of weights, and known words against all distinct words.

    A word counts with its own weight or that of its beginning, whichever is larger.
    """
    hits = [max(weights.get(w, 0.0), weights.get("^" + w[:PREFIX], 0.0)) for w in words if w in weights or "^" + w[:PREFIX] in weights]
    return [1.0, math.log1p(len(hits)), min(sum(hits), 20.0) / 5, len(hits) / math.sqrt(1 + len(words))]


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton steps; more evidence never lowers a score, so features of negative weight are left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, use], y, ridge)
        if len(use) == 1 or w[1:].min() >= 0:
            break
        del use[1 + int(w[1:].argmin())]
    out = np.zeros(x.shape[1])
    out[use] = w
    return out.tolist()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Character counts over all documents; word weights and the regression from at most about fit_rows labelled rows.

    Rows held out (:func:`held_out`) are never learned from. Of labelled texts
    that share a smallest five-word hash only one counts, so that copies do not
    teach their whole wording. A word counts when a binomial bound makes its
    share of toxic documents surprising among all words seen. Without toxic and
    clean rows every score is the share of toxic rows, or 0.
    """
    small_batches(docs.sparkSession)
    counts = _sum_counts(docs, text_col)
    restorer_counts = docs.sparkSession.sparkContext.broadcast(counts)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null").where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "i"), F.lit(1_000_000)) < int(share * 1_000_000))
    joined = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(known, "i")

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("toxicity")
        restorer = Restorer(CharModel(restorer_counts.value))
        for batch in batches:
            out = []
            for i, t, y in zip(batch["i"], batch["t"], batch["y"], strict=True):
                split = t.lower().split()
                grams = [hash_text(" ".join(split[k : k + 5])) for k in range(max(1, len(split) - 4))]
                out.append((i, y, min(grams), min(g ^ 0x5DEECE66D1234567 for g in grams), _with_beginnings(restored_words(t, restorer))))
            yield pd.DataFrame(out, columns=["i", "y", "g", "h", "words"])

    rows = joined.mapInPandas(words_of, "i long, y int, g long, h long, words array<string>")
    for key in ("g", "h"):
        rows = rows.groupBy(key).agg(F.min(F.struct("i", "y", "g" if key == "h" else "h", "words")).alias("r")).select(key, "r.*")
    rows = materialise(rows.select("y", "words"), "toxic-words")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not pos or pos == n:
        base = pos / n if n else 0.0
        return Model(counts, {}, [math.log(base / (1 - base)) if 0 < base < 1 else (30.0 if base else -30.0), 0.0, 0.0, 0.0])
    rate = pos / n
    seen = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where("n >= 3")
    seen = materialise(seen, "toxic-seen")
    tried = max(2, seen.count())
    q = F.least(F.col("pos") / F.col("n"), F.lit(1 - 1e-12))
    surprise = F.col("n") * (q * F.log(q / rate) + (1 - q) * F.log((1 - q) / (1 - rate)))
    chosen = seen.where((q > rate) & (F.length("w") >= 3)).withColumn("s", surprise).where(F.col("s") > math.log(tried)).collect()  # surprising words of at most about fit_rows texts
    weights = {r["w"]: math.log((r["pos"] + 0.5) / (pos + 1)) - math.log((r["n"] - r["pos"] + 0.5) / (n - pos + 1)) for r in chosen}
    weights = {w: x for w, x in weights.items() if x > 1}

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features({x for x in w if x[0] != "^"}, weights) for w in batch["words"]], "y": batch["y"]})

    sample = rows.mapInPandas(featured, "x array<double>, y int").collect()  # at most about fit_rows rows
    return Model(counts, weights, _regression(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float)))


def _with_beginnings(words: set[str]) -> list[str]:
    return sorted(words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX})


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's rows and columns plus a score of 0 to 1 for the whole text; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed-size table and the chosen words

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_state("toxicity")
        weights, w = shared.value.weights, shared.value.coefficients
        restorer = shared.value.restorer()
        for texts in batches:
            z = [sum(a * b for a, b in zip(features(restored_words(t or "", restorer), weights), w, strict=True)) for t in texts.where(texts.notna(), "")]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z])
        del restorer
        trim()

    return docs.drop(score_col).withColumn(score_col, F.pandas_udf(scored, T.DoubleType())(text_col))
