"""Encoding of whole texts word by word, for byte-level tokenizers that split before a space.

A space before a character that is no white space always starts a new piece, and the split of a piece does
not depend on what stands before it. So texts are cut at these spaces, the distinct words of a batch are
encoded once, and their ids are gathered for all places at once with numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each generation of a cache; this bounds memory, not results. Longer words are not kept.
CACHE_ENTRIES, KEPT_LENGTH = 300_000, 64


#: What stands between words that are letters and digits only, in Arrow's regular expressions.
NOT_WORD = r"[^\pL\pN]+"


def flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's lower-case words start in one flat list, the list as numbers, and the words by number."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_WORD)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keep = np.fromiter(map(bool, words), bool, len(words))[place] if words else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets], place[keep], words


class Cache:
    """A mapping of bounded size: a full young generation becomes the old one, and what is asked for again
    moves back to the young."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of each of the distinct keys; ``make`` gives those that aren't known."""
        found = list(map(self.young.get, keys))
        if not (gaps := _gaps(found)):
            return found
        older = list(map(self.old.get, map(keys.__getitem__, gaps)))
        for i, value in zip(gaps, older, strict=True):
            if value is not None:
                found[i] = value
                self._keep(keys[i], value)
        gaps = [i for i, value in zip(gaps, older, strict=True) if value is None]
        for i, value in zip(gaps, make([keys[i] for i in gaps]), strict=True):
            found[i] = value
            if len(keys[i]) <= KEPT_LENGTH:
                self._keep(keys[i], value)
        return found

    def _keep(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        self.young[key] = value


def _gaps(values: list) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def id_bytes(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = list(accumulate((4 * len(x) for x in ids), initial=0))
    return [flat[a:b] for a, b in pairwise(ends)]


def repeated(table: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries at each place, one after the other, and how many each has. ``table``: the entries' values, ``sizes`` of each."""
    first, each = np.cumsum(sizes) - sizes, sizes[place]
    ends = np.cumsum(each)
    n = int(ends[-1]) if len(ends) else 0
    return table[np.repeat((first[place] - (ends - each)).astype(np.int32), each) + np.arange(n, dtype=np.int32)], each


def gathered(values: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for ids in bytes."""
    return repeated(np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4, place)


def joined_words(parts: list[str]) -> list[str]:
    """Parts of a text cut at its spaces, joined again where no character other than white space follows."""
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class WordEncoder:
    """``encode`` gives the ids of each of some strings, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self._encode = encode
        self._words, self._heads = Cache(entries), Cache(entries)

    def _after_space(self, words: list[str]) -> list[bytes]:
        return self._words.recall(words, lambda fresh: self._encode([" " + w for w in fresh]))

    def _one(self, text: str) -> bytes:
        head, *rest = joined_words(text.split(" "))
        distinct = list(dict.fromkeys(rest))
        ids = dict(zip(distinct, self._after_space(distinct), strict=True))
        return self._heads.recall([head], self._encode)[0] + b"".join(map(ids.__getitem__, rest))

    def _word_table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of some distinct words after a space, one after the other, and how many each has."""
        return gathered(self._after_space(words.to_pylist()), np.arange(len(words)))

    def encode_batch(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text; none of the texts is null."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        place, words = coded.indices.to_numpy().copy(), coded.dictionary
        # text that has white space after a space is cut by itself
        start = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
        odd = np.array([not c or c.isspace() for c in start.dictionary.to_pylist()], bool)[start.indices.to_numpy()]
        strange = odd[place]
        strange[offsets[:-1]] = False
        single = set(np.unique(np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1).tolist())
        # heads have no space before them: they get places of their own
        heads, head_at = np.unique(place[offsets[:-1]], return_inverse=True)
        head_table, head_sizes = gathered(self._heads.recall(words.take(pa.array(heads)).to_pylist(), self._encode), np.arange(len(heads)))
        place[offsets[:-1]] = len(words) + head_at
        used = np.bincount(place, minlength=len(words))[: len(words)].astype(bool) & ~odd
        sizes = np.zeros(len(words), np.int64)
        table, sizes[used] = self._word_table(words.filter(pa.array(used)))
        table, sizes = np.concatenate([table, head_table]), np.concatenate([sizes, head_sizes])
        flat, per_word = repeated(table, sizes, place)
        bounds = np.concatenate([[0], np.cumsum(per_word)])[offsets].tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in single:
            out[i] = np.frombuffer(self._one(texts[i].as_py()), "<u4")
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]
