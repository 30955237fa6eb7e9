"""Vectorised hashes of words and character n-grams, for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters of a piece that is worked on at once; longer texts are cut at white space.
PIECE = 1 << 19
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_space = np.zeros(0x3001, bool)
_space[SPACES] = True
_powers: dict[int, np.ndarray] = {}


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_space(points: np.ndarray) -> np.ndarray:
    return _space[np.minimum(points, 0x3000)] & (points <= 0x3000)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about size characters, cut after white space where there is any."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        cut = cut + 1 if cut > at else at + size
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def packed(texts: list[str], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, pieces) whose lengths add up to about size: small texts go together, long ones come in pieces."""
    numbers: list[int] = []
    held: list[str] = []
    room = size
    for i, text in enumerate(texts):
        for piece in pieces(text, size):
            if held and room < len(piece):
                yield numbers, held
                numbers, held, room = [], [], size
            numbers.append(i)
            held.append(piece)
            room -= len(piece) + 1
    if held:
        yield numbers, held


def words_in(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ' ' + ' '.join(held) + ' ', the places of the joints, and start and end (exclusive) of each word."""
    points = codepoints(" " + " ".join(held) + " ")
    joints = np.cumsum([1, *[len(t) + 1 for t in held]])
    space = is_space(points)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return points, joints, edges[0::2], edges[1::2]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(points)
    sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers_of(BASE, n), dtype=np.uint64)
    return mixed((sums[ends - 1] - sums[starts - 1]) * _powers_of(INVERSE, n)[starts])
