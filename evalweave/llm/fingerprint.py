"""Document fingerprints by locally consistent parsing.

Level by level a sequence of symbols (at first bytes) is cut into phrases, and the phrases' names are the next
level's symbols, until one name is left: the root, which names the whole text. Runs of one symbol count as
one. Then deterministic coin tossing sets the cuts: a symbol's label is the lowest bit in which it differs
from its left neighbour, with that bit's value; repeated until labels are below 6, it still differs from
neighbour to neighbour, and phrases start at the labels that are larger than both neighbours'. A cut depends
on some symbols to its left and one to its right only, so equal substrings are cut alike wherever they stand,
except near their ends: they share their interior names.

A fingerprint is the root and a sketch: the least SKETCH distinct hashes of the phrases at SKETCH_LEVEL (some
tens of bytes each), or of the root where there are fewer levels. The likeness of two fingerprints estimates
from the sketches what part of the phrases two texts have in common, 2|A and B| / (|A| + |B|); it is exact
for texts with at most SKETCH phrases, and 1 for equal texts. A text with fewer than FEW phrases there also has a sketch of the finer
phrases of FINE_LEVEL (a few bytes each); two such texts are compared by these, as one phrase more or less would decide.

Defined cases: a null text counts as empty; the empty text has root 0 and an empty sketch, and its likeness
to another is 0; repeated doc_ids are ordered by a hash of their text, then by the text; null doc_ids come first; a single document is
its own successor; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_text, slices
from .ordered import BUCKET, add_bucket, shuffle_width, tie_hash

SKETCH, SKETCH_LEVEL = 48, 3
FINE_LEVEL, FEW = 1, 8
#: Bytes that are parsed at a time (a longer text alone); bounds memory, not results.
GROUP = 1 << 20
ROUNDS_BYTES, ROUNDS_NAMES = 3, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Names of the bytes, and factors of the places in a phrase: a phrase has 11 symbols at most, the first of a text 12.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACES = _mix(np.arange(1001, 1033, dtype=np.uint64) * _ODD) | np.uint64(1)


def toss(symbols: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Labels below 6 that differ from neighbour to neighbour; ``first`` marks where each text starts."""
    starts = np.flatnonzero(first)
    for _ in range(rounds):
        one = symbols.dtype.type(1)
        differ = np.empty_like(symbols)
        np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
        differ[starts] = one
        place = np.bitwise_count((differ - one) & ~differ)
        bit = (symbols >> place.astype(symbols.dtype)) & one
        symbols = (place << np.uint8(1)) | bit.astype(np.uint8)
    return symbols


def parse(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The root of each text, its phrase names at SKETCH_LEVEL and, if these are few, those at FINE_LEVEL (its root, where it
    has fewer levels)."""
    n = len(texts)
    roots, phrases, fine = np.zeros(n, np.uint64), [np.empty(0, np.uint64)] * n, [np.empty(0, np.uint64)] * n
    texts_left = np.array([i for i in range(n) if texts[i]], np.int64)
    if not len(texts_left):
        return roots, phrases, fine
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    names = _BYTES[symbols]
    sizes = np.array([len(texts[i]) for i in texts_left])
    level = 0
    while len(texts_left):
        if level == SKETCH_LEVEL:
            for i, own in zip(texts_left, np.split(names, np.cumsum(sizes)[:-1]), strict=True):
                phrases[i] = own
                if len(own) >= FEW:
                    fine[i] = np.empty(0, np.uint64)
        if level == FINE_LEVEL:
            for i, own in zip(texts_left, np.split(names, np.cumsum(sizes)[:-1]), strict=True):
                fine[i] = own
        done = sizes == 1
        if level and done.any():
            ends = np.cumsum(sizes)
            at = ends[done] - 1
            roots[texts_left[done]] = names[at]
            if level < SKETCH_LEVEL:
                for i, name in zip(texts_left[done], names[at], strict=True):
                    phrases[i] = np.array([name])
            keep = np.ones(len(names), bool)
            keep[at] = False
            names, texts_left, sizes = names[keep], texts_left[~done], sizes[~done]
            symbols = names
            if not len(texts_left):
                break
        names, sizes = _next_level(symbols, names, sizes, ROUNDS_NAMES if level else ROUNDS_BYTES)
        symbols = names
        level += 1
    return roots, phrases, fine


def _next_level(symbols: np.ndarray, names: np.ndarray, sizes: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(symbols), bool)
    first[np.cumsum(sizes) - sizes] = True
    # runs of one symbol
    new = first.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        run = np.diff(at, append=len(symbols)).astype(np.uint64)
        symbols, names, first = symbols[at], names[at], first[at]
        names = np.where(run > 1, _mix(names + run * _ODD), names)
    labels = toss(symbols, first, rounds)
    # phrases start where a text does, and at labels above both neighbours' within the text
    start = first.copy()
    if len(labels) > 2:
        above = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        start[1:-1] |= above & ~first[2:]
    heads = np.flatnonzero(start)
    lengths = np.diff(heads, append=len(names))
    place = np.arange(len(names)) - np.repeat(heads, lengths)
    # a text's last symbol may be next to another text's first: it never starts a phrase, so lengths stay short
    made = np.add.reduceat(names * _PLACES[place], heads)
    owner = np.cumsum(first[heads]) - 1
    return _mix(made + lengths.astype(np.uint64) * _ODD), np.bincount(owner, minlength=len(sizes))


#: Root, sketch, and sketch of fine phrases (empty for texts with many phrases).
Print = tuple[int, np.ndarray, np.ndarray]


def _sketch(names: np.ndarray) -> np.ndarray:
    return np.unique((_mix(names + _ODD) >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def prints(texts: list[bytes]) -> list[Print]:
    """(root, sketch, fine sketch) of each text; a sketch is ascending 32-bit hashes."""
    out: list[Print] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
            size += len(texts[to])
            to += 1
        for root, own, fine in zip(*parse(texts[at:to]), strict=True):
            out.append((int(root), _sketch(own), _sketch(fine)))
        at = to
    return out


def as_text(print_: Print) -> str:
    root, *sketches = print_
    return ":".join([f"{root:016x}", *(s.astype(">u4").tobytes().hex() for s in sketches)])


def from_text(text: str) -> Print:
    root, *sketches = text.split(":")
    coarse, fine = (np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32) for s in sketches)
    return int(root, 16), coarse, fine


def likeness(a: Print, b: Print) -> float:
    """What part of the phrases is shared: of the fine ones, if both texts have few."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if len(a[2]) and len(b[2]):
        return shared_part(a[2], b[2])
    return shared_part(a[1], b[1])


def shared_part(a: np.ndarray, b: np.ndarray) -> float:
    """2|A and B| / (|A| + |B|), from the least hashes of the union of both sketches."""
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        # below the larger of what a full sketch reaches, both sketches are complete
        reach = min(int(x[-1]) for x in (a, b) if len(x) == SKETCH)
        union = union[union <= reach]
    shared = np.intersect1d(np.intersect1d(a, b), union)
    jaccard = len(shared) / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(df: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): the rows dealt by ranges of doc_id and sorted, each range closed by a
    guest, the first row of the next one (of the first, for the last)."""
    marked = add_bucket(df, "doc_id", 4 * shuffle_width(df), "text").withColumn("tie", tie_hash("text"))
    heads = marked.groupBy(BUCKET).agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy(BUCKET).collect()  # a row for each range
    rows = [(h["first"]["doc_id"], h["first"]["tie"], heads[i - 1][BUCKET]) for i, h in enumerate(heads)]
    firsts = df.sparkSession.createDataFrame(rows, "first long, first_tie long, before int")
    found = df.withColumn("tie", tie_hash("text")).join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    guests = found.groupBy(F.col("before").alias("bucket"), "doc_id", "tie").agg(F.min("text").alias("text")).withColumn("guest", F.lit(True))
    own = marked.select(F.col(BUCKET).alias("bucket"), F.lit(False).alias("guest"), "doc_id", "tie", "text")
    placed = own.unionByName(guests).repartition("bucket")
    return placed.sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "tie", "text").drop("tie")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What op4 returns: fingerprints of every whole text and of its edited text, and likenesses."""

    def emit(rows: list[tuple], pieces: list[Print]) -> pa.RecordBatch | None:
        """Each of the rows but the last, with the next one's text."""
        use = [i for i in range(len(rows) - 1) if not rows[i][1]]
        changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in use]
        found = prints(changed)
        return batch_of(
            doc_id=([rows[i][2] for i in use], pa.int64()),
            n_chars=([len(rows[i][3]) for i in use], pa.int64()),
            edited_sha256=([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            fingerprint=([as_text(pieces[i]) for i in use], pa.string()),
            edited_fingerprint=(list(map(as_text, found)), pa.string()),
            near_edited=([likeness(pieces[i], p) for i, p in zip(use, found, strict=True)], pa.float64()),
            near_next=([likeness(pieces[i], pieces[i + 1]) for i in use], pa.float64()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pieces: list[Print] = []
        for part in slices(batches, "text"):
            fresh = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True))
            rows, pieces = rows[-1:] + fresh, pieces[-1:] + prints([r[3].encode() for r in fresh])
            yield emit(rows, pieces)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(id_text(df, id_col, text_col)).mapInArrow(run, schema)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield batch_of(doc_id=(part.column("doc_id"), None), fingerprint=(list(map(as_text, prints([t.encode() for t in part.column("text").to_pylist()]))), pa.string()))

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")
