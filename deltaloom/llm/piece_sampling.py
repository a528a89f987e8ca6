"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

A text's segmentations are the paths of the lattice of its pieces, weighted by the product of piece weights; suffix
sums normalise them. Gumbel top-k: the k distinct segmentations with the largest Gumbel-perturbed log probability,
found by perturbed A-star search. A node of the search is a set of paths (a fixed prefix of words and the
segmentations already taken at the next word); its priority is the largest perturbed value in it, drawn as one
truncated Gumbel. Popping a node draws its best path and splits the rest of the node into one new node for each later
word. The inclusion score of a path is 1 - exp(-exp(log p - kappa)), kappa the (k+1)-th perturbed value (1 if there
are no more than k paths). Draws are hashes of the row's key, the path and the place, so a row gives the same result
wherever it runs.

All of it runs on the arrays of a slice of texts at once: the lattice of the slice's distinct words is built by a trie
walk over all their characters (a worker keeps those of a bounded number of words), a path is drawn for all words of all texts step by step, and each round pops one node
of every text. A new node's value is at most the log probability of its prefix plus the largest Gumbel number that the
generator can give, so nodes behind that bound cannot be popped and are not drawn.
Weights: a unigram model's scores; for a BPE model -log(rank + 1), both times ``alpha``.

Defined cases: null and empty texts have the one empty segmentation; characters outside the vocabulary go to their
byte pieces (or <unk>); repeated keys draw alike; any length is encoded whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read, text_of
from .shingles import mix
from .units import slices

_U = np.uint64
#: Bytes of text that are sampled at once; words whose lattices are built, and drawn from, at once; words whose lattices
#: a worker keeps; new nodes of a path that are drawn at once.
SLICE, BUILD, WALK, KEEP, AHEAD = 2 << 20, 8192, 1 << 15, 120_000, 64
#: The largest number that ``gumbel`` gives is below this; a rest of a word's probability that is summed up, not taken
#: from 1; draws of a word before it is drawn from the rest of its probability.
TOP, RARE, TRIES = 36.75, 1e-10, 4
_MASK, _MIX = (1 << 64) - 1, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PLACE, _STEP, _PATH = (np.array([x], _U) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of 52 bits from unsigned 64-bit counters."""
    x = mix(x)
    x >>= _U(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def one_uniform(x: int) -> float:
    """``uniform`` of one counter."""
    x &= _MASK
    x ^= x >> 30
    x = x * _MIX[0] & _MASK
    x ^= x >> 27
    x = x * _MIX[1] & _MASK
    return ((x ^ x >> 31) >> 12) * 2.0**-52 + 2.0**-53


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges begin..end-1, one range after the other."""
    n = end - begin
    last = np.cumsum(n)
    return np.arange(last[-1] if len(n) else 0) + np.repeat(begin - (last - n), n)


@dataclass
class Graph:
    """The lattices of words, one node for each character. Edges of node i: first[i]..first[i+1]-1, the longest first.

    ``to`` is the node after an edge (-1: the word ends), ``logp`` its log probability given the node, ``pick`` its
    probability (2 for a node's last edge, which is taken if no other is), ``symbol`` its piece or the vocabulary's size
    plus the character that goes to several bytes or to <unk>. ``only``: the word has one path.
    """

    start: np.ndarray
    first: np.ndarray
    to: np.ndarray
    symbol: np.ndarray
    pick: np.ndarray
    logp: np.ndarray
    only: np.ndarray

    def plus(self, more: Graph) -> Graph:
        """The words of this graph, then those of ``more``."""
        nodes, edges = len(self.first) - 1, self.first[-1]
        to = np.where(more.to < 0, -1, more.to + nodes).astype(np.int32)
        joined = ((self.start, more.start + nodes), (self.first[:-1], more.first + edges), (self.to, to), *((getattr(self, c), getattr(more, c)) for c in ("symbol", "pick", "logp", "only")))
        return Graph(*map(np.concatenate, joined))


    def only_words(self, words: np.ndarray) -> Graph:
        stop = np.append(self.start[1:], len(self.first) - 1)
        a, b = self.start[words], stop[words]
        node, edge = spans(a, b), spans(self.first[a], self.first[b])
        start = np.cumsum(b - a) - (b - a)
        to = np.where(self.to[edge] < 0, -1, self.to[edge] + np.repeat(start - a, self.first[b] - self.first[a])).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(self.first[node + 1] - self.first[node])])
        return Graph(start, first, to, self.symbol[edge], self.pick[edge], self.logp[edge], self.only[words])


class Lattice:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = all(float(sp.get_score(i)).is_integer() for i in plain)  # a BPE model's scores are negative ranks
        self.weight = np.zeros(n)
        for i in plain:
            self.weight[i] = alpha * (-log(1 - sp.get_score(i)) if ranks else sp.get_score(i))
        self.far = self.weight[plain].min() - 10 * alpha
        self.weight[[i for i in range(n) if sp.is_byte(i)]] = self.far
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, pieces))
        self.inner = any("▁" in p.lstrip("▁") for p in pieces)
        # Between a letter and a mark that no piece has after a letter, every segmentation has a border.
        before = {c: {a for p in pieces for a, b in zip(p, p[1:]) if b == c} for c in ".,;:!?"}
        marks = "".join(c for c, have in before.items() if not any(pc.match_substring_regex(pa.array(sorted(have)), r"\p{L}").to_pylist()))
        self.ends = rf"(\p{{L}})([{marks}])" if marks else None
        self.known: dict[str, int] = {}
        self.kept: Graph | None = None
        self.feeds = not any("\n" in p and len(p) > 1 for p in pieces)
        # The trie of the pieces: the state after a first character, then an open hash table of keys (state, character).
        states: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p, i in pieces.items():
            at = -1
            for c in p:
                at = states.setdefault((at, ord(c)), len(states))
            ends[at] = i
        self.root = np.full(0x110000, -1, np.int32)
        size = 1 << (2 * len(states)).bit_length()
        self.slots, self.states = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys = np.array([(s + 1) << 21 | c for s, c in states], np.int64)
        for i, (key, at) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at], self.states[at] = key, i
        for (s, c), at in states.items():
            if s < 0:
                self.root[c] = at
        self.piece = np.full(len(states), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        # What an id decodes to, as bytes; ids whose text depends on others or that have none are left to the library.
        value = {i: b for b, i in self.bytes.items()}
        self.plain = np.zeros(n, bool)
        self.plain[[*plain, *self.bytes.values()]] = True
        self.texts = pa.array([bytes([value[i]]) if i in value else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)], pa.binary())

    def lookup(self, words: list[str]) -> tuple[Graph, np.ndarray]:
        """A graph that has ``words``, and their places in it. Beyond KEEP words a worker keeps those that are wanted now."""
        place = list(map(self.known.get, words))
        new = [w for w, i in zip(words, place) if i is None]
        if len(self.known) + len(new) > KEEP:
            still = [w for w, i in zip(words, place) if i is not None]
            self.kept = self.kept.only_words(np.array([i for i in place if i is not None])) if still else None
            self.known = {w: i for i, w in enumerate(still)}
        for i in range(0, max(1, len(new)), BUILD):
            part = self.graph(new[i : i + BUILD])
            self.kept = part if self.kept is None else self.kept.plus(part)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return self.kept, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7C1 >> 40) & (len(self.slots) - 1)

    def after(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's states after one more character each, -1 if there is none."""
        key = (state + 1) << 21 | char
        out, at = np.full(len(key), -1, np.int32), self.slot(key)
        wait = np.arange(len(key))
        while len(wait):
            have = self.slots.take(at)
            hit = np.flatnonzero(have == key.take(wait))
            out[wait.take(hit)] = self.states.take(at.take(hit))
            on = np.flatnonzero((have != key.take(wait)) & (have >= 0))
            wait, at = wait.take(on), (at.take(on) + 1) & (len(self.slots) - 1)
        return out

    def graph(self, words: list[str]) -> Graph:
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        stop = np.repeat(end, size)
        n = len(flat)
        source, symbol = [], []  # by length, from 1
        single = np.array([self.bytes.get(c, self.size + c) if self.bytes else self.size + c for c in range(128)], np.int64)
        at, state = np.arange(n), self.root[flat]
        for length in range(1, self.longest + 1):
            live = state >= 0
            live = np.flatnonzero(live)
            at, state = at.take(live), state.take(live)
            piece = self.piece.take(state)
            ends = np.flatnonzero(piece >= 0)
            here, symbols = at.take(ends), piece.take(ends).astype(np.int64)
            if length == 1:
                alone = np.ones(n, bool)
                alone[here] = False
                alone = np.flatnonzero(alone)
                here, symbols = np.concatenate([here, alone]), np.concatenate([symbols, np.where(flat[alone] < 128, single[flat[alone] & 127], self.size + flat[alone])])
            source.append(here)
            symbol.append(symbols)
            more = np.flatnonzero(at + length < stop.take(at))
            at, state = at.take(more), state.take(more)
            if not len(at):
                break
            state = self.after(state.astype(np.int64), flat.take(at + length))
        count = np.zeros(n, np.int64)
        for here in source:
            count[here] += 1  # a place is in one list at most once
        first = np.concatenate([[0], np.cumsum(count)])
        out_symbol, to = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        filled = first[:-1].copy()
        for length in range(len(source), 0, -1):
            here = source[length - 1]
            out_symbol[filled[here]], to[filled[here]] = symbol[length - 1], here + length
            filled[here] += 1
        w = self.weight[np.minimum(out_symbol, self.size - 1)]
        if len(odd := np.flatnonzero(out_symbol >= self.size)):
            c = out_symbol[odd] - self.size
            w[odd] = self.far * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) if self.bytes else 1)
        # Suffix sums, node by node from each place that no piece crosses.
        crossed = np.zeros(n + 1, np.int64)
        for length in range(2, len(source) + 1):
            crossed[:n] += np.bincount(source[length - 1] + 1, minlength=n + 1)[:n]
            crossed -= np.bincount(source[length - 1] + length, minlength=n + 1)
        cut = np.flatnonzero(np.cumsum(crossed) == 0)
        nodes = np.arange(n)
        far = cut[np.searchsorted(cut, nodes, "right")] - nodes if n else nodes
        within = np.ones(n + 1)
        within[cut] = 0.0
        suffix, logp = np.zeros(n + 1), np.zeros(first[-1])
        most = int(far.max(initial=0))
        order = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=most + 1))])
        for d in range(1, most + 1):
            here = order[bound[d] : bound[d + 1]]
            if not len(here):
                continue
            a = first.take(here)
            k = count.take(here)
            begin = np.cumsum(k) - k
            e = np.arange(begin[-1] + k[-1]) + np.repeat(a - begin, k)
            v = w.take(e) + suffix.take(to.take(e)) * within.take(to.take(e))
            top = np.maximum.reduceat(v, begin)
            suffix[here] = total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, k)), begin))
            logp[e] = v - np.repeat(total, k)
        to[to == np.repeat(stop, count)] = -1
        p = np.exp(logp)
        p[first[1:] - 1] = 2.0
        return Graph(end - size, first, to.astype(np.int32), out_symbol.astype(np.int32), p, logp, first[end] - first[end - size] == size)

    def words(self, norms: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of normalised texts, each text's words as positions in them, and where texts begin."""
        if self.inner:
            coded = pa.array([x for x in norms if x], pa.large_string()).dictionary_encode()
            begin = np.concatenate([[0], np.cumsum([bool(x) for x in norms])]).astype(np.int64)
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), begin
        texts = pa.array(norms, pa.large_string())
        mark = next(c for c in map(chr, (*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))) if not any(c in x for x in norms))
        texts = pc.replace_substring(texts, "▁", mark + "▁")
        for _ in range(2):  # a run of blanks stays with the word after it
            texts = pc.replace_substring(texts, "▁" + mark + "▁", "▁▁")
        if self.feeds:
            texts = pc.replace_substring(texts, "\n", mark + "\n" + mark)
        if self.ends:
            texts = pc.replace_substring_regex(texts, self.ends, rf"\1{mark}\2")
        parts = pc.split_pattern(texts, mark)
        begin = parts.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if "" in words:
            nil = words.index("")
            keep = codes != nil
            begin = np.concatenate([[0], np.cumsum(keep)])[begin]
            codes = codes[keep]
            codes -= codes > nil
            del words[nil]
        return words, codes, begin

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Piece ids of a path's symbols."""
        if not (symbols >= self.size).any():
            return symbols
        out = []
        for s in symbols.tolist():
            if s < self.size:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(s - self.size).encode()] if self.bytes else [self.sp.unk_id()]
        return np.array(out, np.int64)

    def decoded(self, paths: list[np.ndarray]) -> list[str]:
        """The texts of paths of ids, as the library decodes them."""
        flat = np.concatenate([np.zeros(0, np.int64), *paths])
        ends = np.cumsum([0, *map(len, paths)])
        taken = self.texts.take(pa.array(flat))
        offset = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        odd = np.concatenate([[0], np.cumsum(~self.plain[flat])])[ends]
        out = []
        for i, ids in enumerate(paths):
            try:
                if odd[i + 1] > odd[i]:
                    raise UnicodeError
                out.append(data[offset[ends[i]] : offset[ends[i + 1]]].decode().removeprefix(" "))
            except UnicodeError:
                out.append(self.sp.decode(ids.tolist()))
        return out


def walked(g: Graph, words: np.ndarray, base: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A path through the word of each of ``tokens``: edges in the order of tokens, where each token's begin, and log p.

    It is fastest if ``tokens`` are in the order of their words, whose edges then are near each other.
    """
    n = len(words)
    logp, count, parts = np.zeros(n), np.zeros(n, np.int64), []
    # Words that are one edge, marks and line feeds most of all, need no draw.
    edge = g.first.take(g.start.take(words.take(tokens)))
    sure = (g.pick.take(edge) == 2.0) & (g.to.take(edge) < 0)
    done = tokens[sure]
    count[done] = 1
    parts.append((done, 0, edge[sure]))
    tokens = tokens[~sure]
    for lo in range(0, len(tokens), WALK):
        token = tokens[lo : lo + WALK]
        node, own = g.start.take(words.take(token)), base.take(token)
        lp, step = np.zeros(len(token)), 0
        while len(token):
            u = uniform(own + _STEP * _U(step))
            e = g.first.take(node)
            p = g.pick.take(e)
            on = np.flatnonzero(u >= p)
            rest, p, at = u.take(on), p.take(on), e.take(on)
            while len(on):
                rest -= p
                at += 1
                p = g.pick.take(at)
                e[on] = at  # the last one stays
                go = np.flatnonzero(rest >= p)
                on, rest, p, at = on.take(go), rest.take(go), p.take(go), at.take(go)
            lp += g.logp.take(e)
            parts.append((token, step, e))
            node = g.to.take(e)
            live, ended = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
            done = token.take(ended)
            logp[done], count[done] = lp.take(ended), step + 1
            token, node, own, lp = token.take(live), node.take(live), own.take(live), lp.take(live)
            step += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(begin[-1], np.int64)
    for token, step, e in parts:
        flat[begin.take(token) + step] = e
    return flat, begin, logp


class Untaken:
    """What a word's paths leave when some are taken: ``mass[0]``, its probability, and draws from it."""

    def __init__(self, g: Graph, node: int, taken: list[tuple[int, ...]]):
        self.g, self.node, self.next, self.mass = g, [node], [{}], [1.0]  # a trie of the taken paths
        for path in taken:
            self.take(path)

    def take(self, path: tuple[int, ...]) -> None:
        trail = [0]
        for e in path:
            have = self.next[trail[-1]]
            if e not in have:
                have[e] = len(self.node)
                self.node.append(int(self.g.to[e]))
                self.next.append({})
                self.mass.append(1.0)
            trail.append(have[e])
        self.mass[trail[-1]] = 0.0
        for at in reversed(trail[:-1]):
            self.mass[at] = sum(self.weights(self.node[at], at))

    def weights(self, node: int, at: int | None) -> list[float]:
        a = int(self.g.first[node])
        p = np.exp(self.g.logp[a : int(self.g.first[node + 1])]).tolist()
        if at is not None:
            for e, to in self.next[at].items():
                p[e - a] *= self.mass[to]
        return p

    def draw(self, base: int) -> tuple[tuple[int, ...], float]:
        """A path and its log probability among all paths of the word."""
        g, path, at, node, step = self.g, [], 0, self.node[0], int(_STEP[0])
        while node >= 0:
            p = self.weights(node, at)
            u, e = one_uniform(base + step * len(path)) * sum(p), 0
            while e + 1 < len(p) and u >= p[e]:
                u -= p[e]
                e += 1
            while not p[e]:
                e -= 1
            path.append(int(g.first[node]) + e)
            at = None if at is None else self.next[at].get(path[-1])
            node = int(g.to[path[-1]])
        return tuple(path), float(g.logp[path].sum())


class Search:
    """The perturbed A-star search of a slice of texts, a round at a time."""

    def __init__(self, lattice: Lattice, norms: list[str], k: int, seeds: list[int]):
        words, codes, self.begin = lattice.words(norms)
        self.g, place = lattice.lookup(words)
        self.word = place[codes]
        self.order = np.argsort(self.word, kind="stable")
        self.k, n, m = k, len(norms), len(self.word)
        self.seed = mix(np.array(seeds, _U))
        size = np.diff(self.begin)
        place = np.arange(m) - np.repeat(self.begin[:-1], size)
        self.base = np.repeat(self.seed, size) + _PLACE * (place + 1).astype(_U)
        self.flat, self.at, self.logp = [], [], np.zeros((k, m))
        self.value = np.full((k + 1, n), -np.inf)  # perturbed values of the paths, then kappa
        self.parent, self.split = np.full((k, n), -1), np.full((k, n), -1)
        self.new: list[dict[int, tuple[int, ...]]] = [{} for _ in range(k)]
        self.taken: list[dict[int, list[tuple[int, ...]]]] = [{} for _ in range(k)]
        self.left = np.ones((k, n))  # of the word at which a path was split off, without what is taken and itself
        open_value, open_path, open_place = (np.zeros((n, 0)) for _ in range(3))
        live = np.arange(n)
        self.value[0] = gumbel(self.seed + _PATH)
        self._draw(0, live, np.zeros(n, np.int64))
        for r in range(k):
            value, place = self._expand(r, live, k - r)
            pad = np.full((n, value.shape[1]), -np.inf)
            pad[live] = value
            where = np.zeros_like(pad)
            where[live] = place
            open_value, open_path, open_place = np.hstack([open_value, pad]), np.hstack([open_path, np.full_like(pad, r)]), np.hstack([open_place, where])
            best = open_value.argmax(axis=1)
            top = open_value[np.arange(n), best]
            open_value[np.arange(n), best] = -np.inf
            live = np.flatnonzero(top > -np.inf)
            if not len(live):
                break
            self.value[r + 1, live] = top[live]
            if r + 1 < k:
                best = best[live]
                self._split(r + 1, live, open_path[live, best].astype(np.int64), open_place[live, best].astype(np.int64))

    def _draw(self, r: int, texts: np.ndarray, after: np.ndarray) -> None:
        """Path r of ``texts``: a new draw for the words from ``after`` on."""
        here = spans(self.begin[texts] + after, self.begin[texts + 1])
        wanted = np.zeros(len(self.word), bool)
        wanted[here] = True
        flat, at, logp = walked(self.g, self.word, self.base + _PATH * _U(r + 2), self.order[wanted[self.order]])
        self.flat.append(flat)
        self.at.append(at)
        self.logp[r, here] = logp[here]

    def _split(self, r: int, texts: np.ndarray, parent: np.ndarray, split: np.ndarray) -> None:
        self.parent[r, texts], self.split[r, texts] = parent, split
        head = spans(self.begin[texts], self.begin[texts] + split)
        self.logp[r, head] = self.logp[np.repeat(parent, split), head]
        # Draws that repeat what is taken are drawn again; words whose rest is rare are drawn from that rest.
        tokens, wait, path, logp = self.begin[texts] + split, {}, {}, np.zeros(len(texts))
        for i, (t, q, at) in enumerate(zip(texts.tolist(), parent.tolist(), split.tolist())):
            wait[i] = [self.segmentation(t, q, at)] + (self.taken[q][t] if self.split[q, t] == at else [])
            self.taken[r][t] = wait[i]
        for attempt in range(TRIES):
            if not wait:
                break
            here = np.array(list(wait))
            flat, begin, lp = walked(self.g, self.word[tokens[here]], self.base[tokens[here]] + _PATH * _U(1000 + r + 1000 * attempt), np.arange(len(here)))
            logp[here] = lp
            for j, i in enumerate(here.tolist()):
                drawn = tuple(flat[begin[j] : begin[j + 1]].tolist())
                if drawn not in wait[i]:
                    path[i] = drawn
                    del wait[i]
        for i, (t, q, at) in enumerate(zip(texts.tolist(), parent.tolist(), split.tolist())):
            before = self.left[q, t] if self.split[q, t] == at else -np.expm1(self.logp[q, tokens[i]])
            rest = None
            if i in wait or before - np.exp(logp[i]) < RARE:
                rest = Untaken(self.g, int(self.g.start[self.word[tokens[i]]]), self.taken[r][t])
            if i in wait:
                path[i], logp[i] = rest.draw(int(self.base[tokens[i]]) + int(_PATH[0]) * (500 + r))
            self.new[r][t], self.logp[r, tokens[i]] = path[i], logp[i]
            if rest is not None:
                rest.take(path[i])
            self.left[r, t] = before - np.exp(logp[i]) if rest is None else rest.mass[0]
        self._draw(r, texts, split + 1)

    def _expand(self, r: int, texts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``room`` best nodes that the new path r leaves of its node: values (-inf: none) and places."""
        from_ = np.maximum(self.split[r, texts], 0)
        size = self.begin[texts + 1] - self.begin[texts]
        head = np.zeros(len(texts))
        old = spans(self.begin[texts], self.begin[texts] + from_)
        if len(old):
            head += np.bincount(np.repeat(np.arange(len(texts)), from_), self.logp[r, old], len(texts))
        values, places = np.full((len(texts), room), -np.inf), np.zeros((len(texts), room), np.int64)
        rows, skip = np.arange(len(texts)), 0
        while len(rows):
            t = texts[rows]
            place = from_[rows, None] + skip + np.arange(AHEAD)
            there = place < size[rows, None]
            token = np.where(there, self.begin[t][:, None] + place, 0)
            logp = np.where(there, self.logp[r][token] if len(self.word) else 0.0, 0.0)
            before = head[rows, None] + np.cumsum(logp, axis=1) - logp
            free = there & ~self.g.only[self.word[token]] if len(self.word) else there
            left = np.where(free, -np.expm1(logp), 0.0)
            if len(odd := np.flatnonzero(free & (left < RARE) & (place > self.split[r, t][:, None]))):
                left.flat[odd] = self._rest(r, token.flat[odd])
            if not skip:
                own = self.split[r, t] >= 0
                left[own, 0] = self.left[r, t][own]
            some = left > 0
            with np.errstate(divide="ignore", over="ignore"):
                number = gumbel(self.seed[t][:, None] + _PLACE * (place + 1).astype(_U) + _PATH * _U(r + 2000))
                drawn = -np.logaddexp(-self.value[r, t][:, None], -(before + np.log(np.where(some, left, 1.0)) + number))
            drawn = np.hstack([values[rows], np.where(some, drawn, -np.inf)])
            place = np.hstack([places[rows], place])
            best = np.argsort(-drawn, axis=1, kind="stable")[:, :room]
            values[rows], places[rows] = np.take_along_axis(drawn, best, 1), np.take_along_axis(place, best, 1)
            head[rows] += logp.sum(axis=1)
            skip += AHEAD
            rows = rows[(from_[rows] + skip < size[rows]) & (values[rows].min(axis=1) < head[rows] + TOP)]
        return values, places

    def _rest(self, r: int, tokens: np.ndarray) -> np.ndarray:
        """1 - p of path r's segmentations of words, as a sum of what is not taken at their nodes."""
        g, at = self.g, self.at[r]
        e = self.flat[r][spans(at[tokens], at[tokens + 1])]
        node = np.searchsorted(g.first, e, "right") - 1
        k = g.first[node + 1] - g.first[node]
        all_ = spans(g.first[node], g.first[node + 1])
        p = np.where(all_ == np.repeat(e, k), 0.0, np.exp(g.logp[all_]))
        others = np.add.reduceat(p, np.cumsum(k) - k)
        n = at[tokens + 1] - at[tokens]
        sums = np.cumsum(g.logp[e]) - g.logp[e]
        before = sums - np.repeat(sums[np.cumsum(n) - n], n)
        return np.bincount(np.repeat(np.arange(len(tokens)), n), np.exp(before) * others, len(tokens))

    def segmentation(self, t: int, r: int, at: int) -> tuple[int, ...]:
        """The edges of word ``at``, which is not before the place where path r was split off."""
        if at == self.split[r, t]:
            return self.new[r][t]
        token = int(self.begin[t]) + at
        return tuple(self.flat[r][self.at[r][token] : self.at[r][token + 1]].tolist())

    def head(self, t: int, r: int, stop: int) -> list[np.ndarray]:
        """The edges of path r's words before ``stop``, in parts."""
        at, b = int(self.split[r, t]), int(self.begin[t])
        if at < 0:
            return [self.flat[r][self.at[r][b] : self.at[r][b + stop]]]
        if stop <= at:
            return self.head(t, int(self.parent[r, t]), stop)
        return [*self.head(t, int(self.parent[r, t]), at), np.array(self.new[r][t], np.int64), self.flat[r][self.at[r][b + at + 1] : self.at[r][b + stop]]]

    def found(self, t: int) -> list[tuple[np.ndarray, float, float, float]]:
        """(symbols, log p, perturbed value, inclusion score) of a text's paths, largest perturbed value first."""
        b, e = int(self.begin[t]), int(self.begin[t + 1])
        kappa, out = self.value[self.k, t], []
        for r in range(self.k):
            if self.value[r, t] == -np.inf:
                break
            logp = float(self.logp[r, b:e].sum())
            edges = np.concatenate([np.zeros(0, np.int64), *self.head(t, r, e - b)])
            out.append((self.g.symbol[edges].astype(np.int64), logp, float(self.value[r, t]), float(-np.expm1(-np.exp(min(logp - kappa, 700))))))
        return out


def sample(lattice: Lattice, text: str, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
    """Up to k distinct segmentations, largest perturbed value first: (ids, log p, perturbed value, inclusion score)."""
    return [(lattice.ids(s).tolist(), *rest) for s, *rest in Search(lattice, [lattice.sp.normalize(text)], k, [seed]).found(0)]


_lattices: dict = {}


def lattice_of(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def sampled_encodings(df: DataFrame, path: str, k: int, keys: list[str], text_col: str = "text", alpha: float = 1.0) -> DataFrame:
    """``keys``, rank (from 1), ids, log_prob, perturbed, inclusion, decoded text: up to k rows a row of ``df``."""
    schema = df.select(*keys).schema
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, alpha)
        for b in batches:
            done = 0
            for s in slices(b.column("text"), SLICE):
                own = b.slice(done, len(s))
                done += len(s)
                key = [own.column(c).to_pylist() for c in names]
                seeds = [xxhash.xxh3_64_intdigest(json.dumps(x, default=str)) for x in zip(*key)]
                search = Search(lattice, lattice.sp.normalize(s.to_pylist()), k, seeds)
                rows, rank, ids, rest = [], [], [], []
                for t in range(len(s)):
                    for r, (symbols, *numbers) in enumerate(search.found(t), 1):
                        rows.append(t)
                        rank.append(r)
                        ids.append(lattice.ids(symbols))
                        rest.append(numbers)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)
                take = pa.array(rows, pa.int64())
                yield pa.record_batch([*(own.column(c).take(take) for c in names), pa.array(rank, pa.int32()), lists, *(pa.array([x[j] for x in rest], pa.float64()) for j in range(3)), pa.array(lattice.decoded(ids), pa.string())], names=[*names, "rank", "ids", "log_prob", "perturbed", "inclusion", "decoded"])

    narrow = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), text_of(text_col).alias("text"))
    out = arrow_map(narrow, run, ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)) + ", rank int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded string", trim_every=10)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def drawn(spark: SparkSession, sf_dir: str, table: str, keys: list[str]) -> DataFrame:
    """Four segmentations of every text of a table."""
    import public_tokenizers as P

    out = sampled_encodings(read(spark, sf_dir, table, *keys, "text"), P.path("piece_bpe_32k.model"), 4, keys)
    return out.select(*keys, "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole."""
    return drawn(spark, sf_dir, "documents", ["doc_id"])


def op9_turn_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn: subword sampling augments fine-tuning text."""
    return drawn(spark, sf_dir, "conversations", ["conv_id", "turn"])


QUERIES = {"op9_piece_sampling": op9_piece_sampling, "op9_turn_sampling": op9_turn_sampling}
ORACLE_SQL: dict[str, str] = {}
