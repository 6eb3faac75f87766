"""Quality by votes of the nearest labelled neighbours in a latent-semantic space.

A text is a bag of terms: its words, short runs of character classes (letters, capitals, digits, spaces, and every
other character for itself), and repetitions (a word equal to the one k words before). Terms are hashed into buckets and weighted by
the root of their count and by their inverse document frequency over all documents. A truncated SVD of the weighted
bags of a labelled sample gives the latent directions; every document's vector is compared with the vectors of the whole sample, block by
block and exactly, and the nearest ones vote with their similarity and the weight of their class.

The sample of labelled rows is bounded: of each class the first ``SAMPLE_DOCS`` by a hash. Its whole texts are
turned into bags in the tasks; the driver gets counts only, at most 2 x SAMPLE_DOCS x BUCKETS of them. The broadcast holds the
directions and the sample's vectors, (BUCKETS + 2 x SAMPLE_DOCS) x RANK numbers. Document frequencies cover all documents.

Weights, directions and vectors are rounded to integers before they are multiplied, so products are exact in doubles, and a score
depends on the text and the model alone, not on how rows are dealt or batched. Ties between neighbours go to the one with
the smaller id.

Defined cases: a null text counts as empty; a text without terms, or like none of the sample, gets the share of label 1 among the labelled
rows; repeated rows are scored each; of rows that repeat a labelled id the least text (by SHA-256) is learnt from, and of labels that
repeat an id the greatest; an empty table gives an empty one; without labels of both classes all scores are the one class (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, crc32, id_text, map_slices, slices

#: Labelled documents of each class that are learnt from, latent directions, neighbours that vote.
SAMPLE_DOCS, RANK, NEIGHBOURS = 1000, 48, 15
BUCKETS, RUNS, LAGS = 1 << 12, (1, 2, 3, 4), 8
#: Integer steps of weights, directions and unit vectors; with these no product reaches 2^53.
WEIGHT_STEP, DIRECTION_STEP, UNIT_STEP = 1 << 5, 1 << 14, 1 << 12
#: Texts that are compared at a time, and labelled vectors in a block.
TEXTS_AT_ONCE, VECTORS_AT_ONCE = 64, 512

ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """The class of every byte: small letters and bytes of other scripts are one, capitals, digits and white space but newlines too."""
    table = np.arange(256, dtype=np.uint64)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 11, 12, 13]] = ord(" ")
    return table


CLASSES = _classes()
IN_WORD = (CLASSES != ord(" ")) & (CLASSES != ord("\n"))


def _bucket(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * ODD
    return (keys >> np.uint64(52)).astype(np.int64)  # 12 bits


def word_hashes(data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word between ASCII white spaces; ``text`` numbers the text of each byte."""
    inside = np.flatnonzero(IN_WORD[data])
    if not len(inside):
        return inside, np.empty(0, np.uint64)
    owner = text[inside]
    heads = np.flatnonzero((np.diff(inside, prepend=-2) > 1) | (np.diff(owner, prepend=-1) > 0))
    place = (np.arange(len(inside)) - np.repeat(heads, np.diff(heads, append=len(inside)))).astype(np.uint64)
    # a polynomial of the word's bytes and their places, whatever words stand beside it
    mixed = (data[inside] + np.uint64(7)) * (place * ODD + np.uint64(0x100000001B3))
    return owner[heads], np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), heads)


def term_counts(texts: pa.Array) -> np.ndarray:
    """How often each text has terms of each bucket."""
    n = len(texts)
    flat = texts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    text = np.repeat(np.arange(n) * BUCKETS, np.diff(offsets))
    kind = CLASSES[data]
    found = [np.empty(0, np.int64)]
    run = np.zeros(len(data), np.uint64)
    for length in range(1, min(max(RUNS), len(data)) + 1):
        run = run[: len(data) - length + 1] * np.uint64(257) + kind[length - 1 :] + np.uint64(1)
        if length in RUNS:
            keys = _bucket(run * np.uint64(31) + np.uint64(length)) + text[: len(run)]
            found.append(keys[text[: len(run)] == text[length - 1 :]])
    owner, words = word_hashes(data, text)
    found.append(_bucket(words) + owner)
    for lag, again in enumerate(_bucket(np.arange(1, LAGS + 1, dtype=np.uint64) * np.uint64(0xABCDEF)), 1):
        found.append(owner[lag:][(words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])] + again)
    return np.bincount(np.concatenate(found), minlength=n * BUCKETS).reshape(n, BUCKETS)


@dataclass
class Model:
    """``idf`` of each bucket, latent ``directions`` (buckets x rank, whole numbers), the sample's unit ``vectors`` in ascending id order,
    and for each its label and the weight of its class."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    share: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in whole numbers of 1 / UNIT_STEP; zero for a text without terms."""
        return unit_rows(weighted(counts, self.idf) @ self.directions)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        own = self.embed(counts)
        n, m = len(own), len(self.vectors)
        k = min(NEIGHBOURS, m)
        best = np.empty((n, 0), np.int64)
        for at in range(0, m, VECTORS_AT_ONCE):
            products = (own @ self.vectors[at : at + VECTORS_AT_ONCE].T).astype(np.int64)
            # one number for (similarity, smaller place first)
            keys = products * m + (m - 1 - np.arange(at, at + products.shape[1]))
            best = np.concatenate([best, keys], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        similarity, near = np.maximum(best // m, 0), m - 1 - best % m
        votes = similarity * self.weight[near]
        total = np.zeros(n)
        ones = np.zeros(n)
        for j in range(best.shape[1]):
            total += votes[:, j]
            ones += votes[:, j] * self.label[near[:, j]]
        return np.where(total > 0, ones / np.where(total > 0, total, 1), self.share)

    def text_scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), self.share)
        return np.concatenate([np.empty(0), *(self.scores(term_counts(texts.slice(at, TEXTS_AT_ONCE))) for at in range(0, len(texts), TEXTS_AT_ONCE))])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.rint(np.sqrt(counts) * idf * WEIGHT_STEP)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return np.rint(rows / np.where(size > 0, size, 1)[:, None] * UNIT_STEP)


def fit(counts: np.ndarray, label: np.ndarray, idf: np.ndarray, rows_of_class: tuple[int, int], rank: int = RANK) -> Model:
    """``counts``: term counts of the sample, ``rows_of_class``: how many labelled rows each class has in all."""
    share = rows_of_class[1] / max(1, sum(rows_of_class))
    if len(set(label.tolist())) < 2:
        return Model(idf, np.zeros((BUCKETS, 1)), np.empty((0, 1)), label, np.empty(0), share)
    rows = weighted(counts, idf)
    rows /= np.maximum(1e-12, np.linalg.norm(rows, axis=1))[:, None]
    # the right singular vectors, from the smaller Gram matrix
    values, left = np.linalg.eigh(rows @ rows.T)
    keep = np.argsort(-values)[: min(rank, len(values))]
    keep = keep[values[keep] > 1e-9 * values.max()]
    directions = rows.T @ (left[:, keep] / np.sqrt(values[keep]))
    directions *= np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)
    model = Model(idf, np.rint(directions * DIRECTION_STEP), np.empty(0), label.astype(np.int64), np.empty(0), share)
    model.vectors = model.embed(counts)
    sampled = np.maximum(1, np.bincount(label, minlength=2))
    model.weight = (np.array(rows_of_class) / sampled)[label]
    return model


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the rows each bucket occurs, and the number of rows last: BUCKETS + 1 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in slices(batches, "text"):
            column = part.column("text")
            for at in range(0, len(column), TEXTS_AT_ONCE):
                counts = term_counts(column.slice(at, TEXTS_AT_ONCE))
                total[:-1] += (counts > 0).sum(0)
                total[-1] += len(counts)
        if total[-1]:
            yield batch_of(bucket=(pa.array(np.arange(BUCKETS + 1)), None), n=(pa.array(total), None))

    found = np.zeros(BUCKETS + 1, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row.bucket] = row.n
    return found


def inverse_frequencies(frequencies: np.ndarray) -> np.ndarray:
    return np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1]))


def labelled(labels: DataFrame, label_col: str, folds: int, left_out: tuple[int, ...]) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from, one for each id."""
    known = labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return known.where(~(crc32("doc_id") % folds).isin(*left_out)).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_counts(texts: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(term counts, labels) of the bounded sample, in ascending id order."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(SAMPLE_DOCS).unionByName(known.where("label = 0").orderBy(*order).limit(SAMPLE_DOCS))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.sha2("text", 256).alias("digest"), "text")  # at most 2 x SAMPLE_DOCS ids

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        buckets, numbers, ends = [], [], [0]
        for at in range(0, part.num_rows, TEXTS_AT_ONCE):
            for row in term_counts(part.column("text").slice(at, TEXTS_AT_ONCE)):
                own = np.flatnonzero(row)
                buckets.append(own)
                numbers.append(row[own])
                ends.append(ends[-1] + len(own))
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts]), kind))
        return batch_of(**{c: (part.column(c), None) for c in ("doc_id", "label", "digest")}, bucket=(lists(buckets, pa.int32()), None), n=(lists(numbers, pa.int32()), None))

    bags = map_slices(picked, run, "doc_id long, label int, digest string, bucket array<int>, n array<int>", "text")
    rows = bags.groupBy("doc_id", "label").agg(F.min_by(F.struct("bucket", "n"), "digest").alias("bag")).select("doc_id", "label", "bag.bucket", "bag.n").toArrow().sort_by("doc_id").combine_chunks()
    counts = np.zeros((rows.num_rows, BUCKETS), np.int32)
    size = pc.list_value_length(rows["bucket"]).to_numpy().astype(np.int64)
    counts[np.repeat(np.arange(rows.num_rows), size), pc.list_flatten(rows["bucket"]).to_numpy()] = pc.list_flatten(rows["n"]).to_numpy()
    return counts, rows["label"].to_numpy().astype(np.int64)


def fit_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, left_out: tuple[int, ...] = (0,), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on the bounded sample, without documents whose crc32(doc_id) modulo ``folds`` is in ``left_out``."""
    texts = id_text(docs, id_col, text_col)
    known = labelled(labels, label_col, folds, left_out)
    sizes = {row.label: row["count"] for row in known.groupBy("label").count().collect()}
    counts, label = sample_counts(texts, known)
    return fit(counts, label, inverse_frequencies(document_frequencies(texts)), (sizes.get(0, 0), sizes.get(1, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters above, some 3 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=(batch.column("doc_id"), None), score=(pa.array(held.value.text_scores(batch.column("text"))), None))

    return map_slices(id_text(docs, id_col, text_col), run, "doc_id long, score double", "text")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, keep: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from a score of ``keep`` on."""
    found = score(docs, fit_model(docs, labels, folds=folds))
    return found.select("doc_id", (crc32("doc_id") % folds == 0).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))
