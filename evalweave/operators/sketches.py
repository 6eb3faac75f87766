"""Near pairs between cohorts by sketches of k-mers, confirmed on the whole sets.

Equal texts are one class. A class' sketch is the least SIZE hashes of its distinct k-mers. The distance of two sketches is -ln(2j / (1 + j)) / k, where
j is the share of the least SIZE hashes of their union that both have. A cut-off on the distance is a least j, hence a least number t of common hashes. So,
in any one order of all hashes, two sketches that near share one of the first n - t + 1 of each; the order is from rare to frequent, by counts over all
sketches, so that classes meet at what is particular to them, and no pair within the cut-off is missed. Only pairs of different cohorts are made.

Texts are numbered, and only numbers and hashes are shuffled: each hash once, to find those that several sketches have. Texts that are near the same one are
put into blocks, and blocks that share a hash are judged together, so a text is read and hashed once for many pairs.

What sketches find is then confirmed: the Jaccard similarity and the coverage of the smaller set, both on all k-mers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import spread_join
from .ordered import positions

K, SIZE, MOST = 21, 1000, 0.05
#: Confirmation: the identity that the whole sets' distance leaves, and the coverage of the smaller set.
IDENTITY, COVERAGE = 0.95, 0.6
#: Texts that a task works on at a time; rows that are broadcast at most, of one long each.
STEP, FEW = 512, 1_000_000
#: Entries that a task deals at a time, and the buckets (2^BUCKET_BITS). Rows of a block, one for each bit of a long, and blocks of a run.
HELD, BUCKET_BITS = 1 << 20, 10
BLOCK, RUN = 64, 8
ODD = np.uint64(0x9E3779B97F4A7C15)


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """Ascending distinct hashes of the runs of k characters, as signed numbers; of the whole text if it is shorter; none if empty."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.int64)
    k = min(k, len(codes))
    codes += np.uint64(1)
    run = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        run ^= run >> np.uint64(29)
        run *= ODD
        run += codes[i : i + len(run)]
    run ^= run >> np.uint64(32)
    run *= ODD
    run ^= run >> np.uint64(29)
    run = run.view(np.int64)
    run.sort()
    return run[np.r_[True, run[1:] != run[:-1]]]


def least_similarity(most: float, k: int) -> float:
    """The Jaccard similarity that the distance ``most`` stands for."""
    x = math.exp(-k * most)
    return x / (2 - x)


def text_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((digest, text, one for each text), (digest, cohort, id: the least of the class in the cohort, n)). ``df``: id, cohort, text."""
    rows = df.where("text is not null and text <> '' and id is not null and cohort is not null").select("id", "cohort", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    members = rows.groupBy("digest", "cohort").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return rows.groupBy("digest").agg(F.first("text").alias("text")), members


def sketches(texts: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """(row, sketch): the least hashes of each text, ascending. ``texts``: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP)):
                found = [kmer_hashes(t, k)[:size] for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))], names=["row", "sketch"])

    return texts.select("row", "text").mapInArrow(run, "row long, sketch array<long>")


def at_rows(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``df`` that are in a pair (a, b); their numbers are broadcast only if they are few."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    return df.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "row", "left_semi")


def dealt(parts: Iterator[dict[str, np.ndarray]], key: str) -> Iterator[pa.RecordBatch]:
    """Entries, given as columns of numbers, as rows of (bucket, a column's numbers as bytes, ...): equal ``key`` (a column), equal bucket."""
    held, size = [], 0
    for part in chain(parts, [None]):
        if part is not None and len(part[key]):
            held.append(part)
            size += len(part[key])
        if held and (part is None or size >= HELD):
            columns = {name: np.concatenate([p[name] for p in held]) for name in held[0]}
            bucket = ((columns[key].view(np.uint64) * ODD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int16)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            ends = np.r_[at, len(order)]
            packed = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at].astype(np.int32)), *packed], names=["bucket", *columns])
            held, size = [], 0


def buckets(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """The entries of one bucket after another, from rows of ``dealt`` that are sorted by bucket."""
    now, held = None, []
    whole = lambda: {name: np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, (name, kind) in enumerate(kinds.items())}
    for batch in batches:
        for bucket, *values in zip(*(batch.column(name).to_pylist() for name in ("bucket", *kinds)), strict=True):
            if bucket != now and held:
                yield whole()
                held = []
            now = bucket
            held.append(values)
    if held:
        yield whole()


def leads(sets: DataFrame, least: float) -> DataFrame:
    """(row, n, hash, near): of each set the hashes, from rare to frequent, at one of which it meets every set as similar as ``least``, without those
    that no other set has; near is the least row of the sets that share a hash with it, by most of its hashes. ``sets``: row, sketch.

    Hashes are dealt into buckets to be counted, and those that several sets have are dealt back by row to be ranked. Entries move as runs of
    numbers, many to a row of Spark's.
    """
    named = {"row": np.int64, "n": np.int32, "hash": np.int64}
    counted = named | {"often": np.int32, "near": np.int64}
    move = lambda df, kinds: df.repartition("bucket").sortWithinPartitions("bucket").select("bucket", *kinds)
    schema = lambda kinds: "bucket int, " + ", ".join(f"{name} binary" for name in kinds)

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict[str, np.ndarray]]:
            for batch in batches:
                sketch, n = batch.column("sketch"), pc.fill_null(pc.list_value_length(batch.column("sketch")), 0).to_numpy(zero_copy_only=False)
                yield {"row": np.repeat(batch.column("row").to_numpy(), n), "n": np.repeat(n, n).astype(np.int32), "hash": sketch.flatten().to_numpy()}

        return dealt(entries(), "hash")

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict[str, np.ndarray]]:
            for found in buckets(batches, named):
                order = np.argsort(found["hash"], kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(found["hash"][order]) != 0])
                size = np.diff(np.r_[at, len(order)])
                often, near = np.repeat(size, size).astype(np.int32), np.repeat(np.minimum.reduceat(found["row"][order], at), size)
                keep = often > 1  # a set's own hashes lead nowhere
                yield {name: c[order][keep] for name, c in found.items()} | {"often": often[keep], "near": near[keep]}

        return dealt(entries(), "row")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in buckets(batches, counted):
            order = np.lexsort((found["hash"], found["often"], found["row"]))
            row, n = found["row"][order], found["n"][order].astype(np.int64)
            at = np.flatnonzero(np.r_[True, np.diff(row) != 0])
            size = np.diff(np.r_[at, len(row)])
            # hashes that only one set has come first in the order
            first = n - np.ceil(least * n - 1e-9) + 1 - (n - np.repeat(size, size))
            keep = np.arange(len(row)) - np.repeat(at, size) < first
            # the longest run of one near in each row
            by = np.lexsort((found["near"], found["row"]))
            ours, nears = found["row"][by], found["near"][by]
            runs = np.flatnonzero(np.r_[True, (np.diff(ours) != 0) | (np.diff(nears) != 0)])
            best = np.lexsort((np.diff(np.r_[runs, len(by)]), ours[runs]))
            last = np.flatnonzero(np.r_[np.diff(ours[runs][best]) != 0, True])
            near = np.repeat(nears[runs][best][last], size)
            yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(n[keep].astype(np.int32)), pa.array(found["hash"][order][keep]), pa.array(near[keep])], names=["row", "n", "hash", "near"])

    # a number, a size and a hash are all that moves of a set's entry, once
    often = move(sets.select("row", "sketch").mapInArrow(by_hash, schema(named)), named).mapInArrow(by_row, schema(counted))
    return move(often, counted).mapInArrow(rank, "row long, n int, hash long, near long")


def similar_sets(sets: DataFrame, most: float) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of sets (row, sketch) whose Jaccard distance is below ``most``."""
    lead = materialise(leads(sets, 1 - most).select("row", "n", "hash"))
    other = lead.select("hash", F.col("row").alias("other"), F.col("n").alias("m"))
    fits = F.least("n", "m") >= (1 - most) * F.greatest("n", "m") - 1e-9
    pairs = materialise(spread_join(lead, other, ["hash"], "row").where((F.col("row") < F.col("other")) & fits).select(F.col("row").alias("a"), F.col("other").alias("b")).distinct())
    some = materialise(at_rows(sets, pairs))
    side = lambda name, column: some.select(F.col("row").alias(name), F.col("sketch").alias(column))
    both = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.select("a", "b", (F.col("common") / (F.size("s") + F.size("t") - F.col("common"))).alias("jaccard")).where(1 - F.col("jaccard") < most)


def tiles(lead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, at), (block, other, own, others)): rows in an order in which those that are near the same row lie together, in blocks of BLOCK, and
    pairs of blocks (block <= other) with the rows of each, as bits, that share a hash with the other's. ``lead``: row, hash, near.

    Many rows of few blocks that share a hash meet as blocks, not as pairs.
    """
    places = materialise(positions(lead.groupBy("row").agg(F.min("near").alias("near")), [F.col("near"), F.col("row")], "at").select("row", "at"))
    placed = lead.join(places, "row").select("hash", F.floor(F.col("at") / BLOCK).alias("block"), F.expr(f"shiftleft(1L, cast(at % {BLOCK} as int))").alias("bit"))
    masks = materialise(placed.groupBy("hash", "block").agg(F.bit_or("bit").alias("own")))
    others = masks.select("hash", F.col("block").alias("other"), F.col("own").alias("others"))
    met = spread_join(masks, others, ["hash"], "block").where((F.col("block") < F.col("other")) | (F.col("block") == F.col("other")) & (F.bit_count("own") > 1))
    return places, met.groupBy("block", "other").agg(F.bit_or("own").alias("own"), F.bit_or("others").alias("others"))


def judge(blocks: list[tuple[int, int, int, int]], at: np.ndarray, cohort: np.ndarray, texts: list[str], k: int, size: int, most: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, distance, jaccard, coverage), as arrays, of the pairs of texts that ``blocks`` (as of ``tiles``) bring together and whose sketches are
    within the cut-off; a and b are indices of ``at``, the ascending places of the texts. Texts of one ``cohort`` (a number, or -1) aren't compared.

    Every text is hashed once. The places of a's hashes in the union with b's are their places in both, less what is common up to there.
    Whole sets are compared only of texts whose sketches are near.
    """
    sets = [kmer_hashes(t, k) for t in texts]
    sizes = np.array([len(s) for s in sets])
    bits = lambda block, mask: np.searchsorted(at, block * BLOCK + np.flatnonzero(mask >> np.arange(BLOCK) & 1))
    partners: dict[int, list[np.ndarray]] = {}
    for block, other, own, others in blocks:
        found = bits(other, others)
        for a in bits(block, own).tolist():
            partners.setdefault(a, []).append(found)

    def numbered(some: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The arrays with their hashes numbered, and a zero for each number."""
        ids = np.unique(np.concatenate(some), return_inverse=True)[1].astype(np.int32)
        return np.split(ids, np.cumsum([len(x) for x in some])[:-1]), np.zeros(ids.max() + 1, np.int32)

    heads, place = numbered([s[:size] for s in sets])
    near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, found in partners.items():
        bs = np.unique(np.concatenate(found))
        bs = bs[(bs > a) & ((cohort[bs] != cohort[a]) | (cohort[a] < 0))]
        if not len(bs):
            continue
        place[heads[a]] = np.arange(1, len(heads[a]) + 1, dtype=np.int32)  # of a hash in a's
        own = place[np.concatenate([heads[b] for b in bs])]
        place[heads[a]] = 0
        ends = np.cumsum(np.minimum(sizes[bs], size))
        starts = np.r_[0, ends[:-1]]
        shared = own > 0
        upto = np.cumsum(shared)
        before = np.r_[0, upto[ends[:-1] - 1]]
        rank = own + np.arange(1, len(own) + 1) - upto - np.repeat(starts - before, ends - starts)
        common = np.add.reduceat(shared & (rank <= size), starts, dtype=np.int64)
        both = np.add.reduceat(shared, starts, dtype=np.int64)
        j = common / np.minimum(size, len(heads[a]) + ends - starts - both)
        with np.errstate(divide="ignore"):
            distance = np.maximum(0.0, -np.log(2 * j / (1 + j)) / k)
        if (distance <= most).any():
            near[a] = bs[distance <= most], distance[distance <= most]
    if not near:
        return
    some = np.unique(np.concatenate([list(near), *(bs for bs, _ in near.values())]))
    ids, place = numbered([sets[i] for i in some])
    whole = dict(zip(some.tolist(), ids, strict=True))
    for a, (bs, distance) in near.items():
        place[whole[a]] = 1
        common = np.add.reduceat(place[np.concatenate([whole[b] for b in bs.tolist()])], np.r_[0, np.cumsum(sizes[bs])[:-1]], dtype=np.int64)
        place[whole[a]] = 0
        yield np.full(len(bs), a), bs, distance, common / (sizes[a] + sizes[bs] - common), common / np.minimum(sizes[a], sizes[bs])


def judged_pairs(texts: DataFrame, lead: DataFrame, members: DataFrame, k: int = K, size: int = SIZE, most: float = MOST) -> DataFrame:
    """(a, b, distance, jaccard, coverage): pairs of rows within the cut-off, in either order, of classes with members of different cohorts.
    ``texts``: row, text; ``lead``: row, hash, near; ``members``: row, cohort.

    A task judges pairs of RUN by RUN blocks at a time, for which a text is read once.
    """
    places, blocks = tiles(lead)
    run = lambda column: F.floor(F.col(column) / RUN)
    blocks = materialise(blocks.select(run("block").alias("run"), run("other").alias("run_other"), "block", "other", "own", "others"))
    asked = blocks.select("run", "run_other", F.explode(F.array(F.struct("block", F.col("own").alias("mask")), F.struct(F.col("other").alias("block"), F.col("others").alias("mask")))).alias("x"))
    asked = asked.groupBy(F.col("run").alias("of"), F.col("run_other").alias("of_other"), F.col("x.block").alias("block")).agg(F.bit_or("x.mask").alias("mask"))
    wanted = asked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where("getbit(mask, bit) = 1").select("of", "of_other", (F.col("block") * BLOCK + F.col("bit")).alias("at"))
    # the cohort of a class that has only one
    only = members.groupBy("row").agg(F.when(F.min("cohort") == F.max("cohort"), F.min("cohort")).alias("only"))
    read = wanted.join(places, "at").join(texts.select("row", "text"), "row").join(only, "row").select("of", "of_other", "at", "row", "only", "text")

    def confirm(key: tuple[pa.Scalar, ...], ours: pa.Table, read: pa.Table) -> pa.Table:
        read = read.sort_by("at")
        at, row = (read.column(c).to_numpy() for c in ("at", "row"))
        cohort = pc.fill_null(read.column("only").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        found = list(judge(list(zip(*(ours.column(c).to_pylist() for c in ("block", "other", "own", "others")), strict=True)), at, cohort, read.column("text").to_pylist(), k, size, most))
        a, b, *values = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, t) for t in (int, int, float, float, float))
        return pa.table([row[a], row[b], *values], names=["a", "b", "distance", "jaccard", "coverage"])

    return blocks.groupBy("run", "run_other").cogroup(read.groupBy("of", "of_other")).applyInArrow(confirm, "a long, b long, distance double, jaccard double, coverage double")


def sketch_pairs(df: DataFrame, k: int = K, size: int = SIZE, most: float = MOST, identity: float = IDENTITY, coverage: float = COVERAGE) -> DataFrame:
    """(cohort_a, a, copies_a, cohort_b, b, copies_b, distance, jaccard, coverage, confirmed): pairs of classes of two cohorts within the
    cut-off; a class is named by its least id in the cohort, and stands for that many copies. ``df``: id, cohort, text.

    Nulls and empty texts have no k-mers and drop out; classes within one cohort aren't compared.
    """
    texts, members = text_classes(df)
    texts = materialise(texts.withColumn("row", F.monotonically_increasing_id()))
    members = materialise(members.join(texts.select("digest", "row"), "digest").select("row", "cohort", "id", "n"))
    lead = materialise(leads(sketches(texts, k, size), least_similarity(most, k)).select("row", "hash", "near"))
    judged = materialise(judged_pairs(texts, lead, members, k, size, most))
    agrees = (F.col("jaccard") >= least_similarity(1 - identity, k)) & (F.col("coverage") >= coverage)
    of = lambda name: members.select(F.col("row").alias(f"row_{name}"), F.col("cohort").alias(f"cohort_{name}"), F.col("id").alias(name), F.col("n").alias(f"copies_{name}"))
    named = judged.withColumnsRenamed({"a": "row_a", "b": "row_b"})
    turned = judged.withColumnsRenamed({"b": "row_a", "a": "row_b"}).select(*named.columns)
    # a class of several cohorts is a pair with itself
    shared = members.groupBy("row").agg(F.count("*").alias("cohorts")).where("cohorts > 1")
    itself = shared.select(F.col("row").alias("row_a"), F.col("row").alias("row_b"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("coverage")).where(F.lit(most >= 0))
    found = named.unionByName(turned).unionByName(itself).join(of("a"), "row_a").join(of("b"), "row_b").where("cohort_a < cohort_b")
    return found.select("cohort_a", "a", "copies_a", "cohort_b", "b", "copies_b", "distance", "jaccard", "coverage", agrees.alias("confirmed"))
