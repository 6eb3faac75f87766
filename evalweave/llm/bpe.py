"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end its encoding: the last token of that
prefix's own encoding. So one array of last tokens holds the encodings of all prefixes at once. A new
byte needs only the tokens that end there, and the one whose left neighbour is compatible with it wins;
appends never touch what is stored, and an edit needs new work from the edit to the end of its piece.

Two tokens are compatible if merging their joined bytes gives just these two back; an encoding is right
if and only if all its neighbours are compatible.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows give repeated rows;
an empty table gives an empty one; other columns of the input are ignored and cannot clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_left, bisect_right
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, held, id_text, map_slices
from .words import CACHE_ENTRIES, Cache, WordEncoder, id_bytes

#: Pairs that a worker remembers before it starts afresh; this bounds memory, not results.
PAIR_ENTRIES = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Between pieces in one long string: no byte, so no token spans it. No token ends there.
GAP, NOTHING = "\u0100", -1


class PrefixBPE:
    """Encoder of single pieces (matches of the split pattern) over given ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"a byte-level vocabulary needs every byte; {len(missing)} are missing")
        #: The longest token that ends in each byte: no longer suffix is tried.
        self.longest = [0] * 256
        for token in ranks:
            self.longest[token[-1]] = max(self.longest[token[-1]], len(token))
        self._pairs: dict[int, bool] = {}
        self._single: dict[int, bool] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merges by definition: the lowest rank first, the leftmost of equals. For short byte strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _alone(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        if (known := self._single.get(token)) is None:
            known = self._single[token] = self._merge(self.token_bytes[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self._alone(right) and self._merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fills ``last`` (last[i]: last token of data[:i+1]) from its present length to all of ``data``."""
        get, pairs, longest = self.ranks.get, self._pairs.get, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest[data[end - 1]]), end):
                token = get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if self._alone(token):
                        break
                    continue
                before = last[start - 1]
                known = pairs(before << 32 | token)
                if known or known is None and self.compatible(before, token):
                    break
            last.append(token)
        return last

    def tokens_of(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, read back from the array."""
        out = []
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= len(self.token_bytes[token])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the rank format's own library."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.tokens_of(self.extend(data, []), len(data))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The same for many pieces: an automaton over the vocabulary lists the tokens that end at each
        byte, the longest first, and the first compatible one is stored."""
        if not pieces:
            return []
        text = GAP + GAP.join(p.decode("latin-1") for p in pieces)
        last = [NOTHING] * len(text)
        pairs, compatible, alone, done = self._pairs.get, self.compatible, self._alone, -1
        for end, (token, length) in self.automaton.iter(text):
            if end == done:
                continue
            before = last[end - length]
            if before == NOTHING:
                if not alone(token):
                    continue
            else:
                known = pairs(before << 32 | token)
                if known is False or known is None and not compatible(before, token):
                    continue
            last[end] = token
            done = end
        out, end = [], 0
        for piece in pieces:
            end += len(piece) + 1
            whole = self.ranks.get(piece)
            if whole is not None:
                out.append([whole])
            else:
                ids, at, stop = [], end - 1, end - 1 - len(piece)
                while at > stop:
                    ids.append(last[at])
                    at -= len(self.token_bytes[last[at]])
                out.append(ids[::-1])
        return out

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


#: The split pattern decides about a piece by at most this many characters after it.
LOOKAHEAD = 4


class EditableEncoding:
    """A text with the stored last tokens of every prefix of every piece; exact under appends and edits."""

    def __init__(self, encoder: PrefixBPE, pattern: str, text: str = ""):
        self.encoder, self.split = encoder, regex.compile(pattern)
        self.text, self.starts, self.pieces, self.last = "", [], [], []
        self.reused = 0
        self.replace(0, 0, text)

    def _piece(self, piece: str, near: tuple[bytes, list[int]] | None = None) -> tuple[bytes, list[int]]:
        """Its bytes and last tokens; what it shares with the start of ``near`` is taken over."""
        data = piece.encode()
        shared = 0
        if near is not None:
            top = min(len(data), len(near[0]))
            shared = next((i for i in range(top) if data[i] != near[0][i]), top)
        return data, self.encoder.extend(data, list(near[1][:shared]) if near else [])

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] = new. Pieces that end well before, and those after the first old boundary at
        which the new split arrives again, are kept as they are."""
        keep = max(0, bisect_right(self.starts, max(0, start - LOOKAHEAD)) - 2)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        at = self.starts[keep] if keep < len(self.starts) else 0
        fresh_starts, fresh, tail = [], [], len(self.starts)
        for match in self.split.finditer(text, at):
            old = match.start() - shift
            if match.start() >= start + len(new) and old >= end:
                i = bisect_left(self.starts, old)
                if i < len(self.starts) and self.starts[i] == old:
                    tail = i
                    break
            k = bisect_left(self.starts, match.start())
            near = self.pieces[k] if k < len(self.starts) and self.starts[k] == match.start() else None
            fresh_starts.append(match.start())
            fresh.append(self._piece(match.group(), near))
        self.reused = keep + len(self.starts) - tail
        self.text = text
        self.starts = self.starts[:keep] + fresh_starts + [s + shift for s in self.starts[tail:]]
        self.pieces = self.pieces[:keep] + fresh + self.pieces[tail:]

    def ids(self) -> list[int]:
        out: list[int] = []
        for data, last in self.pieces:
            whole = self.encoder.ranks.get(data)
            out.extend([whole] if whole is not None else self.encoder.tokens_of(last, len(data)))
        return out


class TextEncoder(WordEncoder):
    """Whole texts: words are looked up, and all new pieces of a batch share one pass of the encoder."""

    def __init__(self, encoder: PrefixBPE, pattern: str, entries: int = CACHE_ENTRIES):
        super().__init__(self._encode_words, entries)
        self.encoder, self.split = encoder, regex.compile(pattern)
        self._pieces = Cache(entries)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        split = list(map(self.split.findall, words))
        distinct = list({piece for parts in split for piece in parts})
        ids = dict(zip(distinct, self._pieces.recall(distinct, self._encode_pieces), strict=True))
        return [b"".join(map(ids.__getitem__, parts)) for parts in split]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return id_bytes(self.encoder.encode_pieces([p.encode() for p in pieces]))


def _encoder(path: str, pattern: str, entries: int = CACHE_ENTRIES) -> TextEncoder:
    """One for each worker process; it outlives the task, until a task of another stage drops it."""

    def make() -> TextEncoder:
        encoder = TextEncoder(PrefixBPE(load_ranks(path)), pattern, entries)
        gc.collect()
        gc.freeze()  # the vocabulary stays: no need to look through it again and again
        return encoder

    return held(("bpe", path, pattern, entries), make)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, each match of ``pattern`` encoded separately.

    ``ranks_path`` must be readable on every executor (an installed package's file).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(ranks_path, pattern)
        ids = encoder.encode_batch(batch.column("text"))
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        return batch_of(doc_id=(batch.column("doc_id"), None), ids=(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), None))

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>", "text")


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes`` to (doc_id, ids): the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _decoder(ranks_path)
        return batch_of(doc_id=(batch.column("doc_id"), None), ids=(batch.column("ids"), None), bytes=([encoder.decode(x) for x in batch.column("ids").to_pylist()], pa.binary()))

    return map_slices(df.select("doc_id", df[ids_col].alias("ids")), run, "doc_id long, ids array<int>, bytes binary", "ids")


@cache
def _decoder(path: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path))


def encoding_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", entries: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both.

    Both steps run in one task on the same ids, so neither ids nor bytes pass through the JVM. ``entries``
    bounds each generation of a worker's caches; it sets memory and time, not results.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(ranks_path, pattern, entries)
        decimal = _decimals(len(encoder.encoder.token_bytes)).__getitem__
        n, ids_sha, decoded_sha = [], [], []
        for array in encoder.encode_batch(batch.column("text")):
            ids = array.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
            decoded_sha.append(hashlib.sha256(encoder.encoder.decode(ids)).hexdigest())
        return batch_of(doc_id=(batch.column("doc_id"), None), n_tokens=(n, pa.int64()), ids_sha256=(ids_sha, pa.string()), decoded_sha256=(decoded_sha, pa.string()))

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")


@cache
def _decimals(n: int) -> list[bytes]:
    return list(map(str.encode, map(str, range(n))))
