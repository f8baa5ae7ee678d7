"""Word shingles as sorted sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at once; about 60 bytes of memory each, which a worker keeps in part.
WINDOW = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.Philox(20240501))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)])) for b in (_U(_BASE), _U(_INVERSE))]
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of bytes other than ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = _power_tables(len(raw) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_CODE[raw] * up[: len(raw)])])
    value = (total[end] - total[start]) * down[start]
    return start, mix(value + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the lower-cased (A-Z only) words of each text, in order.

    Texts are hashed in windows of WINDOW bytes; a longer text is cut at white
    space, so memory stays bounded but for a single word of more than that.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            joined = b"\n".join(group)
            start, value = _hash_words(joined)
            begins = np.cumsum([0, *[len(t) + 1 for t in group]])
            cut = np.searchsorted(start, begins)
            out.extend(value[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
            group.clear()
            size = 0

    for text in texts:
        text = text.translate(_LOWER)
        if len(text) > WINDOW:
            flush()
            parts, at = [], 0
            while at < len(text):
                stop = min(len(text), at + WINDOW)
                while stop < len(text) and not _SPACE[text[stop]]:
                    stop += 1
                parts.append(_hash_words(text[at:stop])[1])
                at = stop
            out.append(np.concatenate(parts))
            continue
        if size + len(text) > WINDOW:
            flush()
        group.append(text)
        size += len(text) + 1
    flush()
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a shorter text is one shingle, one without words none."""
    out = []
    for words in word_hashes([(t or "").encode("utf-8", "replace") for t in texts]):
        n = len(words)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(k, n)
        value = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            value = mix(value * _U(0xA0761D6478BD642F) + words[i : n - width + 1 + i])
        out.append(np.unique(value))
    return out
