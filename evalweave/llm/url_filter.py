"""URL filters: all glob rules at once over each canonical URL, by a bit-parallel automaton.

Every rule is a glob over ``host + path``. In a glob ``*`` stands for any bytes but ``/``, ``**`` for any
bytes and ``?`` for one byte but ``/``. A pattern of m bytes takes m + 1 bits in a row, packed
with those of the other patterns into 64-bit words. For each character of the URL, Shift-And moves every
active bit on by one, carries between words, and keeps the bits whose pattern takes that character there; bits
before a star also stay where they are. numpy steps a whole batch of URLs at a time, and URLs whose state can
no longer change leave the batch.

A rule for a host and path fits the host, its subdomains, and paths that start with the rule's: the globs
``host/path**`` and ``*.host/path**``. Of the rules that fit, the longest decides (the sum of host and path;
of equal ones the first). Without any the verdict is ``default``: the automaton found nothing against it.

Defined cases: a null URL or one without ``://`` has an empty host and path; long URLs are read whole; repeated
rows give repeated rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_slices

SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """``host`` in lower case, ``path`` from its first slash on or empty, ``verdict`` allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """An empty path fits any path of the host, the empty one too."""
        tails = [self.path + "**"] if self.path else ["", "/**"]
        return [host + tail for host in (self.host, "*." + self.host) for tail in tails]


class GlobAutomaton:
    """Masks of several globs over bytes. ``owner[p]`` numbers what pattern p belongs to."""

    def __init__(self, globs: list[str]):
        bits = []  # per state: what it takes to get here from the one before, and what it may stay on
        first, accept = [], []
        for glob in globs:
            first.append(len(bits))
            bits.append([np.zeros(256, bool), np.zeros(256, bool)])
            data = glob.encode()
            at = 0
            while at < len(data):
                stars = 2 if data[at : at + 2] == b"**" else int(data[at : at + 1] == b"*")
                if stars:
                    slash = bits[-1][1][SLASH] or stars == 2
                    bits[-1][1][:] = True
                    bits[-1][1][SLASH] = slash
                    at += stars
                    continue
                takes = np.zeros(256, bool)
                if data[at] == ord("?"):
                    takes[:] = True
                    takes[SLASH] = False
                else:
                    takes[data[at]] = True
                bits.append([takes, np.zeros(256, bool)])
                at += 1
            accept.append(len(bits) - 1)
        n = len(bits)
        self.words = max(1, -(-n // 64))
        self.move = self._masks([b[0] for b in bits])
        self.stay = self._masks([b[1] for b in bits])
        self.start = self._set(first)
        self.accept = [(a // 64, np.uint64(1 << (a % 64))) for a in accept]
        #: Accepting states that stay on every character: nothing can change them any more.
        self.final = self._set([a for a in accept if bits[a][1].all()])

    def _set(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1 << (s % 64))
        return out

    def _masks(self, tables: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s, table in enumerate(tables):
            out[table, s // 64] |= np.uint64(1 << (s % 64))
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """A row of booleans for each URL: which globs take all of it."""
        state = np.tile(self.start, (len(urls), 1))
        size = np.array(list(map(len, urls)), np.int64)
        data = np.frombuffer(b"".join(urls), np.uint8)
        begin = np.cumsum(size) - size
        live, at = np.flatnonzero(size > 0), 0
        while len(live):
            now, taken = state[live], data[begin[live] + at]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = shifted & self.move[taken] | now & self.stay[taken]
            state[live] = now
            at += 1
            live = live[(size[live] > at) & (now & ~self.final).any(1)]
        return np.stack([(state[:, word] & bit) != 0 for word, bit in self.accept], 1) if self.accept else np.zeros((len(urls), 0), bool)


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[GlobAutomaton, np.ndarray, np.ndarray]:
    """The automaton, the rule of each pattern, and the rules from the longest on."""
    globs = [(i, g) for i, rule in enumerate(rules) for g in rule.globs()]
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    return GlobAutomaton([g for _, g in globs]), np.array([i for i, _ in globs]), np.array(order)


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lowered) and path: what stands between the first ``://`` and the next of ``/?#``, and from
    there to the next of ``?#``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, whole, 2)


def filter_urls(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every URL."""
    host, path = url_parts(F.col("url"))
    urls = df.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = tuple(rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, owner, order = _compiled(ruled)
        canonical = [(h + p).encode() for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        took = automaton.run(canonical)
        fits = np.zeros((len(canonical), len(ruled)), bool)
        for pattern, rule in enumerate(owner):
            fits[:, rule] |= took[:, pattern]
        best = np.full(len(canonical), -1)
        if len(ruled):
            ranked = fits[:, order]
            best = np.where(ranked.any(1), order[ranked.argmax(1)], -1)
        names = [ruled[b].name if b >= 0 else None for b in best]
        verdicts = [ruled[b].verdict if b >= 0 else default for b in best]
        return batch_of(page_id=(batch.column("page_id"), None), host=(batch.column("host"), None), path=(batch.column("path"), None), rule=(names, pa.string()), verdict=(verdicts, pa.string()))

    return map_slices(urls, run, "page_id long, host string, path string, rule string, verdict string")
