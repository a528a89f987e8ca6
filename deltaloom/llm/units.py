"""Encoding whole texts through a bounded memo of space-separated units.

A byte-level or word-level BPE never merges across the border between a character that is not white space and a
following space. So a text is a row of units (" word", with whatever else hangs on it), and each unit's ids do not
depend on its neighbours. Arrow splits a slice of texts and finds its distinct units; only units that are new to a
worker go to the tokenizers library; numpy lays the results out again. The memo keeps two generations of at most
``limit`` units each, so memory is bounded whatever the input.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out at once; a longer text is a slice of its own.
SLICE = 4 << 20
#: Bytes of text whose distinct units are looked up at once.
LOOKUP = 8 << 20
#: Units that the library encodes in one call, and in one text of that call.
LOT, JOINED = 8192, 128


class Memo:
    """unit -> value for closed units, in two generations of about ``limit`` keys each."""

    def __init__(self, solve: Callable[[list[str]], list], limit: int):
        self.solve, self.limit = solve, limit
        self.new: dict = {}
        self.old: dict = {}

    def values(self, units: list[str]) -> list:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, units))
        if None in got:
            miss = [i for i, v in enumerate(got) if v is None]
            ask = []
            for i in miss:
                if (v := self.old.get(units[i])) is None:
                    ask.append(i)
                else:
                    got[i] = self.new[units[i]] = v
            for i, v in zip(ask, self.solve([units[i] for i in ask]), strict=True):
                got[i] = self.new[units[i]] = v
        return got


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """The array in order, in slices of about ``size`` bytes."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield pa.concat_arrays([texts.slice(at, to - at)])  # a copy without offset: some Arrow kernels misread slices
        at = to


def left_open(words: pa.LargeStringArray) -> np.ndarray:
    """Whether each word is empty or ends in white space. The last byte settles it for most."""
    end = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = end[1:] == end[:-1]
    last = np.zeros(len(words), np.uint8)
    last[~out] = data[end[1:][~out] - 1]
    for i in np.flatnonzero((last <= 32) | (last > 127)).tolist():
        out[i] = out[i] or words[i].as_py()[-1].isspace()
    return out


def joined(parts: list[str]) -> list[str]:
    """Units of a text whose split at spaces has parts that are empty or end in white space: these stay open to the next."""
    units, at = [], parts[0]
    for p in parts[1:]:
        if at and not at[-1].isspace():
            units.append(at)
            at = ""
        at += " " + p
    return [u for u in [*units, at] if u]


class Units:
    """``solve(list of unit strings) -> list of values``. ``newline_splits``: a line feed is a border like a space."""

    def __init__(self, solve: Callable[[list[str]], list], limit: int = 250_000, newline_splits: bool = False):
        self.memo = Memo(solve, limit)
        self.newline_splits = newline_splits

    def laid_out(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Of one slice without nulls: values of distinct units, each text's units as positions in them, and where texts begin."""
        if self.newline_splits:
            texts = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        begin = parts.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        open_ = left_open(coded.dictionary)
        first = begin[:-1]
        units = [" " + w for w in words]
        head = {}  # the first part of a text has no space before it
        for i in first:
            w = words[codes[i]]
            codes[i] = head.setdefault(w, len(units) + len(head))
        units += head
        open_ = np.concatenate([open_, np.array([not w or w[-1].isspace() for w in head], bool)])
        odd = np.flatnonzero(np.add.reduceat(open_[codes], first)) if len(first) else first
        if len(odd):
            used, extra, rows = np.ones(len(first), bool), {}, {}
            used[odd] = False
            for d in odd:
                p = flat.slice(begin[d], begin[d + 1] - begin[d]).to_pylist()
                rows[d] = [len(units) + extra.setdefault(u, len(extra)) for u in joined(p)]
            cut = [np.asarray(rows[d], np.int64) if d in rows else codes[begin[d] : begin[d + 1]] for d in range(len(first))]
            begin = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
            codes = np.concatenate(cut)
            units += extra
            left = np.unique(codes)
            again = np.zeros(len(units), np.int64)
            again[left] = np.arange(len(left))
            units, codes = [units[i] for i in left], again[codes]
        return self.memo.values(units), codes, begin

    def sums(self, texts: pa.Array) -> np.ndarray:
        """For numbers as values: their sum by text."""
        out = [np.zeros(0, np.int64)]
        for s in slices(texts, LOOKUP):
            values, codes, begin = self.laid_out(s)
            total = np.concatenate([[0], np.cumsum(np.asarray(values, np.int64)[codes])])
            out.append(total[begin[1:]] - total[begin[:-1]])
        return np.concatenate(out)

    def arrays(self, texts: pa.Array, kind: str) -> Iterator[np.ndarray]:
        """For bytes of ``kind`` as values: one array by text, in order."""
        for s in slices(texts, LOOKUP):
            values, codes, begin = self.laid_out(s)
            ids = np.frombuffer(b"".join(values), kind)
            size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
            start = np.cumsum(size) - size
            n = size[codes]
            end = np.cumsum(n)
            at = np.repeat(start[codes] - (end - n), n)
            at += np.arange(len(at))
            flat = ids[at]
            ends = np.concatenate([[0], end])
            for a, b in zip(ends[begin[:-1]], ends[begin[1:]], strict=True):
                yield flat[a:b]


_loaded: dict = {}


def library(path: str):
    """The tokenizers library's tokenizer of a file, once for each worker process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encoder(path: str, newline_splits: bool = False, memo: int = 500_000) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """Texts -> for each its unsigned 16- or 32-bit ids, equal to the library's ids of the whole text.

    ``newline_splits``: for a vocabulary that drops all white space. ``memo``: units in each generation of the memo.
    """
    key = ("encoder", path, newline_splits, memo)
    if key not in _loaded:
        tok = library(path)
        kind = id_type(tok.get_vocab_size(with_added_tokens=True))

        def plain(units: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, kind).tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]

        # A special token splits the text before anything else looks at it, so units joined by one are encoded as if alone.
        cut = next((i for i, t in tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)), None)
        seam = None if cut is None else tok.id_to_token(cut)

        def solve(units: list[str]) -> list[bytes]:
            out = []
            for i in range(0, len(units), LOT):  # the library's encodings are many times their ids
                lot = units[i : i + LOT]
                if seam is None or len(lot) < 2:
                    out += plain(lot)
                    continue
                parts = [lot[j : j + JOINED] for j in range(0, len(lot), JOINED)]
                for part, e in zip(parts, tok.encode_batch_fast([seam.join(x) for x in parts], add_special_tokens=False), strict=True):
                    ids = np.asarray(e.ids, kind)
                    ends = (np.flatnonzero(ids == cut) * ids.itemsize).tolist()
                    if len(ends) != len(part) - 1:  # a unit holds that token's string
                        out += plain(part)
                        continue
                    flat = ids.tobytes()
                    out += [flat[a:b] for a, b in zip([0, *(x + ids.itemsize for x in ends)], [*ends, len(flat)], strict=True)]
            return out

        units = Units(solve, memo, newline_splits)
        odd = [t.content for t in tok.get_added_tokens_decoder().values() if any(c.isspace() for c in t.content)]

        def encode(texts: pa.Array) -> Iterator[np.ndarray]:
            if not odd:
                return units.arrays(texts, kind)
            return (np.frombuffer(solve([t])[0], kind) for t in texts.to_pylist())  # its special strings span units

        _loaded[key] = encode
    return _loaded[key]


def id_type(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def vocabulary_size(path: str) -> int:
    return library(path).get_vocab_size(with_added_tokens=True)
