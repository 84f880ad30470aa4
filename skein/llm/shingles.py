"""Distinct word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text handled at once; bounds memory (a longer text is handled alone).
GROUP_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """sets(texts) yields (first text, one past the last, text numbers, hashes): the distinct hashes of each text
    in rising order, text by text.

    Words are maximal runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than k words
    but at least one has its whole word sequence as its only shingle; one without words has none.
    """

    def __init__(self, k: int, seed: int = 0):
        self.k, self.seed = k, seed
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, GROUP_BYTES)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]))
            self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))

    def sets(self, texts: list[str | None]):
        coded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        first = size = 0
        for i, t in enumerate(coded):
            if i > first and size + len(t) > GROUP_BYTES:
                yield (first, i, *self._sets(coded[first:i]))
                first, size = i, 0
            size += len(t) + 1
        if first < len(coded):
            yield (first, len(coded), *self._sets(coded[first:]))

    def _sets(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
        self._powers(len(data) + 1)
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in coded])])
        edge = np.flatnonzero(np.diff(~self.space[data], prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[data] * self.power[: len(data)], dtype=np.uint64)])
        word = mix(((total[end] - total[begin]) * self.inverse[begin]) ^ ((end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        text = np.searchsorted(base, begin, side="right") - 1
        n = np.bincount(text, minlength=len(coded))
        parts_text, parts_hash = [], []
        k = self.k
        if len(word) >= k:
            inside = text[: len(word) - k + 1] == text[k - 1 :]
            parts_text.append(text[: len(inside)][inside])
            parts_hash.append(self._chain([word[j : len(word) - k + 1 + j][inside] for j in range(k)]))
        at = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            if len(short):
                parts_text.append(short)
                parts_hash.append(self._chain([word[at[short] + j] for j in range(m)]))
        if not parts_text:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text, hashed = np.concatenate(parts_text), np.concatenate(parts_hash)
        order = np.lexsort((hashed, text))
        text, hashed = text[order], hashed[order]
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
        return text[keep], hashed[keep]

    def _chain(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(words[0]), np.uint64((len(words) + self.seed * int(BASE)) & (1 << 64) - 1), np.uint64)
        for w in words:
            out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + w)
        return out
