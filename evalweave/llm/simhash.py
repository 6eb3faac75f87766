"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that differ in at most three bits
differ in at most one bit of some segment, so each fingerprint enumerates the Hamming ball of radius one of
each segment, fetches the fingerprints whose segment equals a member, and verifies the complete distance.

What keeps large groups linear: equal fingerprints are one node. Before the index is probed, nodes within two
bits are joined by the radius-one balls of the whole fingerprint: two balls meet just when the distance is at
most two, so each ball member points at its least owner, and no pairs are made. Segment values that only
occur within one group so found need no look-up at all; the other candidates are verified inside the join.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other; repeated rows give repeated rows; rows with a null doc_id share in the links, and their component is
named by the least id that isn't null, or null if it has none; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .common import batch_of, id_text, map_slices, materialise, text_digests, unused
from .components import components

SEED, WORDS, BITS, SEGMENT, DISTANCE = 42, 3, 64, 32, 3
#: Shingles whose bits are unpacked at a time, for very long texts.
STEP = 1 << 14


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero.

    bytes.lower() lowers A-Z only, and bytes.split() splits at exactly the six ASCII white spaces.
    """
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join
    digest = xxhash.xxh64_digest
    shingles = map(joined, zip(*(parts[i:] for i in range(words)), strict=False))
    hashes = b"".join([digest(s, SEED) for s in shingles])  # big-endian
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), STEP):
        counts += np.unpackbits(rows[at : at + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp): the SHA-256 of every whole text, and its fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = np.array(list(map(fingerprint, texts)), np.uint64)
        return batch_of(doc_id=(batch.column("doc_id"), None), digest=(text_digests(texts), None), fp=(pa.array(found.view(np.int64)), None))

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, digest binary, fp long", "text")


def _bits(n: int) -> F.Column:
    """An array of the longs that have one of the lowest ``n`` bits set."""
    return F.array(*(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(n)))


def _within_two(nodes: DataFrame) -> DataFrame:
    """Edges that connect all fingerprints within two bits: each ball member's owners to the least of them."""
    balls = nodes.select("fp", F.explode(F.concat(F.array("fp"), F.transform(_bits(BITS), lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("member"))
    least = F.min("fp").over(Window.partitionBy("member"))
    return balls.select("fp", least.alias("least")).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def _across_groups(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between fingerprints of different groups. ``nodes``: (fp, group)."""
    low = (1 << SEGMENT) - 1
    segments = F.array(
        F.struct(F.lit(0).alias("segment"), F.shiftrightunsigned("fp", SEGMENT).alias("value")),
        F.struct(F.lit(1).alias("segment"), F.col("fp").bitwiseAND(F.lit(low)).alias("value")),
    )
    stored = nodes.select("fp", "group", F.explode(segments).alias("s")).select("fp", "group", "s.segment", "s.value")
    # of two values one bit apart, the one with the bit unset probes: each pair meets once
    value = F.col("value")
    ball = F.concat(F.array(value), F.transform(F.filter(_bits(SEGMENT), lambda bit: value.bitwiseAND(bit) == 0), lambda bit: value.bitwiseOR(bit)))
    probes = stored.select("segment", F.explode(ball).alias("key"), F.lit(False).alias("here"), "fp", "group")
    rows = stored.select("segment", value.alias("key"), F.lit(True).alias("here"), "fp", "group").unionByName(probes)
    # a key matters if a fingerprint is stored there and those that meet come from two groups or more
    met = Window.partitionBy("segment", "key")
    mixed = rows.select("*", F.min("group").over(met).alias("first"), F.max("group").over(met).alias("last"), F.max("here").over(met).alias("stored"))
    mixed = materialise(mixed.where("stored and first <> last").select("segment", "key", "here", "fp", "group"))
    table = mixed.where("here").select("segment", "key", "fp", "group")
    visits = mixed.where("not here").select("segment", "key", F.col("fp").alias("other"), F.col("group").alias("other_group"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE
    pairs = table.join(visits, (table.segment == visits.segment) & (table.key == visits.key) & (F.col("group") != F.col("other_group")) & near)
    return pairs.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def fingerprint_classes(docs: DataFrame) -> DataFrame:
    """(fp, component_id): the class of every fingerprint, named by its least id. ``docs``: (doc_id, fp)."""
    nodes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    close = materialise(_within_two(nodes.select("fp")))
    groups = components(close)
    known = materialise(nodes.select("fp").join(groups.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group")))
    links = _across_groups(known)
    # the groups found first are whole: what remains is to connect them with each other
    names = known.select(F.col("fp").alias("a"), F.col("group").alias("ga"))
    others = known.select(F.col("fp").alias("b"), F.col("group").alias("gb"))
    between = links.join(names, "a").join(others, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    merged = components(between).select(F.col("node").alias("group"), "label")
    named = known.join(merged, "group", "left").select("fp", F.coalesce("label", "group").alias("label"))
    member = nodes.join(named, "fp")
    least = member.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return member.join(least, "label").select("fp", "component_id", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the class of every document under links of at most DISTANCE bits."""
    docs = materialise(fingerprints(df, id_col, text_col).select("doc_id", "fp"))
    classes = fingerprint_classes(docs).select("fp", "component_id")
    # a fingerprint that many documents share is dealt out
    named = spread_join(docs, classes, ["fp"], "doc_id")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, label): the class of every row; rows of one text, and of one label, are alike."""
    docs = materialise(fingerprints(df, id_col, text_col))
    return spread_join(docs, fingerprint_classes(docs).select("fp", "label"), ["fp"], "doc_id").select("doc_id", "digest", "label")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Callable[[DataFrame, str, str], DataFrame] = row_classes, parts: int = 256) -> DataFrame:
    """One row of each class of ``df``: the one with the least id, and of rows that repeat it the least SHA-256 of the text.

    A repeated id alone is no copy: rows of one id with different texts each stand for their own class. Rows without an id
    can't be named and stay as they are. ``classes`` gives (doc_id, digest, label) for every row.
    """
    named, ident, digest, rank, deal = F.col(f"`{id_col}`"), *(unused(df, name) for name in ("__id", "__digest", "__rank", "__deal"))
    rows = materialise(classes(df, id_col, text_col).where("doc_id is not null"))
    kept = rows.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("r")).select(F.col("r.doc_id").alias(ident), F.col("r.digest").alias(digest))
    # rows that repeat both id and text on more than a ``parts``-th of the table, fewer than ``parts`` kinds
    often = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where(F.col("n") * parts > rows.count()).where("n > 1")
    often = materialise(often.select(F.col("doc_id").alias(ident), F.col("digest").alias(digest), F.lit(True).alias(rank)))
    keyed = df.where(named.isNotNull()).withColumn(ident, named.cast("long")).withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    every = F.when(F.col(rank), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    if some := not often.isEmpty():
        # dealt by where they lie, as equal rows have equal hashes
        keyed = keyed.join(F.broadcast(often), [ident, digest], "left").withColumn(deal, F.when(F.col(rank), F.spark_partition_id() % parts).otherwise(0)).drop(rank)
        kept = kept.join(F.broadcast(often), [ident, digest], "left").withColumn(deal, F.explode(every)).drop(rank)
    keys = [ident, digest, *([deal] if some else [])]
    first = lambda rows, by: rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(ident))).where(F.col(rank) == 1).drop(rank)
    one = first(keyed.join(kept, keys), keys)
    if some:  # one of each deal is left of these
        mark = one.join(F.broadcast(often), [ident, digest], "left")
        one = mark.where(F.col(rank).isNull()).drop(rank).unionByName(first(mark.where(F.col(rank)).drop(rank), [ident, digest]))
    return one.select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(df.where(named.isNull()))
