"""Vectorised hashes of the words of normalized texts (one space between words, a line end last)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

CUT = 1 << 18  # bytes that are hashed at once, more only if one word is longer
BASE = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str | None) -> bytes:
    """A-Z in lower case, one space between words, a line end last; words are runs of anything but ASCII white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pieces(bodies: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for i, body in enumerate(bodies):
        at = 0
        while at < len(body):
            end = at + CUT
            if end < len(body):
                space = body.rfind(b" ", at, end)
                space = space if space > at else body.find(b" ", end)
                end = space if space > 0 else len(body)
            held.append((i, body[at:end]))
            size += end - at
            at = end
            if size >= CUT:
                yield held
                held, size = [], 0
    if held:
        yield held


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 .. n - 1 modulo 2^64, and their inverses."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x)], dtype=np.uint64) for x in (BASE, inverse))


def word_hashes(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hash of each word, index of its body), in order, some bodies at a time.

    A word's hash is a polynomial of its bytes: a difference of running sums over all bytes, taken back to the word's start.
    """
    for held in _pieces(bodies):
        b = np.frombuffer(b"\n".join(p for _, p in held) + b"\n", np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = (b != 32) & (b != 10)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, after = edges[::2], edges[1::2]
        if not len(starts):
            continue
        powers, inverses = _powers(max(2 * CUT, 1 << len(b).bit_length()))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=sums[1:])
        ends = np.cumsum([len(p) + 1 for _, p in held])
        body = np.array([i for i, _ in held])[np.searchsorted(ends, starts, side="right")]
        yield mix((sums[after] - sums[starts]) * inverses[starts]), body
