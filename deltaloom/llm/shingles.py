"""Hashed word-shingle sets and SetSketch registers of whole texts, by Arrow and numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A set holds 64-bit hashes of the distinct
``width``-word shingles; a text of fewer words is one shingle; a text without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .units import slices

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift), for arrays."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text begins in them."""
    flat = pc.ascii_lower(texts.cast(pa.large_string()))
    for space in "\t\n\v\f\r":
        flat = pc.replace_substring(flat, space, " ")
    parts = pc.split_pattern(flat, " ")
    begin = parts.offsets.to_numpy().astype(np.int64)
    begin = begin - begin[0]
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), _U, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # white space at an end or in a run
        keep = codes != words.index("")
        begin = np.concatenate([[0], np.cumsum(keep)])[begin]
        codes = codes[keep]
    return hashes[codes], begin


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    scale = mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    for s in slices(texts):
        h, begin = word_hashes(s)
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, _U)
        for j in range(width):
            rolled += h[j : j + n] * scale[j]
        rolled = mix(rolled)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * scale[: b - a]).sum(dtype=_U) + _U(b - a)], _U))
            else:
                yield np.zeros(0, _U)


class SetSketch:
    """Registers K_i = floor(1 - log_base(min over the set of h_i)), truncated to 0 .. limit+1, h_i exponential of rate ``rate``.

    The minimum of the exponentials is taken on their uniform variates, which has the same order; registers of a union
    are the element-wise maximum. Base 1.001, rate 20 and 16 bits are the constants proposed with the sketch.
    """

    def __init__(self, size: int = 128, base: float = 1.001, rate: float = 20.0, limit: int = (1 << 16) - 2, seed: int = 1):
        self.size, self.base, self.rate, self.limit = size, base, rate, limit
        draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, size), dtype=np.uint64).astype(np.uint32)
        self.a, self.b = draw[0] | np.uint32(1), draw[1]

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(self.size, np.uint16)
        x = (hashes >> _U(32)).astype(np.uint32)
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            v = x[i : i + 512, None] * self.a
            v += self.b
            np.minimum(low, v.min(axis=0), out=low)
        u = (low.astype(np.float64) + 0.5) / 2.0**32
        h = -np.log1p(-u) / self.rate
        return np.clip(np.floor(1 - np.log(h) / np.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    @staticmethod
    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def jaccard(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, step: float = 0.01) -> np.ndarray:
        """Maximum-likelihood similarity of pairs of rows of registers, given the set sizes.

        The counts of larger, smaller and equal registers are trinomial with probabilities p(u - vJ), p(v - uJ) and the
        rest, p(x) = -log_base(1 - x (base-1)/base), u and v the sizes' shares; J runs over a grid up to min(u/v, v/u).
        """
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = self.size - more - less
        u = n_a / np.maximum(n_a + n_b, 1)
        v = 1 - u
        p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (self.base - 1) / self.base) / np.log(self.base)
        best, at = np.full(len(u), -np.inf), np.zeros(len(u))
        most = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
        for j in np.arange(0, 1 + step / 2, step):
            j = np.minimum(j, most)
            up, down = p(u - v * j), p(v - u * j)
            like = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
            better = like > best
            best, at = np.where(better, like, best), np.where(better, j, at)
        return at
