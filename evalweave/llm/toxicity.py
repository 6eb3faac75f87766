"""Toxicity by subword bags: embeddings of character n-grams, averaged into a linear softmax.

A word is the mean of the vectors of its n-grams (with its ends marked) and of the word itself, a window is the mean
of its words (a short text is filled up with empty ones), and a softmax over two classes judges the window. All
vectors and weights are trained jointly in numpy. A misspelt word shares most of its n-grams with the known one.

A document's score is that of its most toxic window, as a few words decide about long documents. Labels are
known for documents only: training starts with the label for every window, then keeps, of the toxic
documents, the windows that the model itself picks out. Words that it then finds toxic are also shown misspelt.
Lastly the threshold moves to where it separates the sampled documents best.

The sample for training is bounded: of each class the first ``SAMPLE_DOCS`` labelled documents by a hash, but
those over ``SAMPLE_TEXT`` bytes, and of these as many as ``SAMPLE_BYTES`` hold. The texts of the sample are read
whole, window by window. Everything else reads whole texts of all documents. A score depends on its text and
the sample only, not on how rows are partitioned or batched.

Defined cases: a null text counts as empty; a text without words gets the score of an empty window; repeated
rows are scored each; an empty table gives an empty one; without labels of both classes all scores are the
share of the one class (0 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, crc32, held, id_text, map_slices, slices
from .words import CACHE_ENTRIES, Cache, flat_words

#: Bounds of the training sample: labelled documents of each class, bytes of a text that is taken, bytes of all
#: texts of a class.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_BYTES = 1500, 1 << 18, 12 << 20
WINDOW, STRIDE = 4, 2
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4, 5)
#: Steps of each of 1 + ROUNDS fits, windows in a step.
STEPS, ROUNDS, BATCH, RATE, SEED = 200, 2, 256, 0.3, 7
#: Worst windows of a clean document that later fits draw from, and what part of the logit of their document's
#: worst window makes windows of toxic documents toxic.
HARDEST, CLOSE = 4, 0.5
#: What scoring and training work on at a time; bounds memory, not results.
WORDS_AT_ONCE, DOCS_AT_ONCE = 20_000, 64
#: Part of the n-grams that each step of training leaves out, so that none of a word's n-grams is indispensable.
DROPPED = 0.4
#: How many toxic documents that stay weigh as much as a clean one that goes, where the threshold is set.
CLEAN_COUNTS = 3
#: Part of the toxic words that a step sees misspelt, misspellings of each, and the documents such a word occurs in.
EDITED, EDITS, LEAST_DOCS, SHORTEST_EDITED = 0.4, 40, 4, 4


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``flat_words``, but a word that is repeated at once counts once: long runs say no more than the word."""
    starts, place, words = flat_words(texts)
    again = np.zeros(len(place), bool)
    again[1:] = place[1:] == place[:-1]
    again[starts[:-1][starts[:-1] < len(place)]] = False
    before = np.concatenate([[0], np.cumsum(~again)])
    return before[starts], place[~again], words


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, marked at both ends, and of each word as a whole."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    powers = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    powers ^= powers >> np.uint64(29)
    position = np.arange(len(codes), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64)
    whole = np.add.reduceat(powers * (position * np.uint64(2) + np.uint64(1)), ends - sizes) if len(words) else np.empty(0, np.uint64)
    found, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        hashed = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            hashed = hashed * np.uint64(0x100000001B3) + powers[k : len(codes) - n + 1 + k]
        inside = word[: len(hashed)] == word[n - 1 :]
        found.append(hashed[inside])
        owners.append(word[: len(hashed)][inside])
    hashed = np.concatenate(found)
    hashed ^= hashed >> np.uint64(32)
    return ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def sorted_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams, word by word, and how many each word has."""
    buckets, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE]
        bucket, owner = word_grams(some)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.uint16))  # BUCKETS is 2^16
        sizes.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(buckets), np.concatenate(sizes)


def window_bounds(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, end) of the windows: WINDOW words every STRIDE, a last one at the end of the text, and
    one empty window for a text without words."""
    n = np.diff(starts)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(0, np.minimum(k * STRIDE, n[text] - WINDOW))
    return text, starts[text] + first, starts[text] + np.minimum(first + WINDOW, n[text])


@dataclass
class Model:
    """What scoring needs: for each n-gram bucket its part of the difference of the two logits."""

    bucket: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = [np.empty(0)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            bucket, word = word_grams(some)
            out.append(np.bincount(word, self.bucket[bucket], len(some)) / np.bincount(word, minlength=len(some)))
        return np.concatenate(out)

    def text_logits(self, texts: pa.Array, cache: Cache) -> np.ndarray:
        starts, place, words = split_words(texts)
        known = cache.recall(words, lambda fresh: self.word_scores(fresh).tolist())
        text, first, end = window_bounds(starts)
        logits = window_sums(np.array(known, float), place, first, end) / WINDOW + self.bias
        return np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(starts) - 1))) if len(text) else logits


def window_sums(values: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of values[place[first:end]] of each window, word by word: what else is in the batch can't change it."""
    total = np.zeros(len(first))
    ordered = values[place] if len(place) else np.zeros(0)
    for k in range(WINDOW):
        at = np.flatnonzero(first + k < end)
        total[at] += ordered[first[at] + k]
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one letter changed, dropped, added or swapped with the next; short words as they are."""
    if len(word) < SHORTEST_EDITED:
        return word
    kind, at, letter = rng.integers(4), int(rng.integers(len(word))), word[int(rng.integers(len(word)))]
    if kind == 0:
        return word[:at] + letter + word[at + 1 :]
    if kind == 1:
        return word[:at] + word[at + 1 :]
    if kind == 2:
        return word[:at] + letter + word[at:]
    return word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """As ``split_words`` over all texts, and in how many texts each word occurs; DOCS_AT_ONCE texts at a time."""
    number: dict[str, int] = {}
    starts, places, docs = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], np.empty(0, np.int64)
    for at in range(0, len(texts), DOCS_AT_ONCE):
        own_starts, place, words = split_words(pa.array(texts[at : at + DOCS_AT_ONCE], pa.string()))
        numbers = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
        starts.append(own_starts[1:] + starts[-1][-1])
        places.append(numbers[place])
        text = np.repeat(np.arange(len(own_starts) - 1), np.diff(own_starts))
        pairs = np.unique(text * max(1, len(words)) + place)
        seen = np.bincount(numbers[pairs % max(1, len(words))], minlength=len(number)) if len(pairs) else np.zeros(len(number), np.int64)
        seen[: len(docs)] += docs
        docs = seen
    return np.concatenate(starts), np.concatenate(places), list(number), docs


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the ranges first[i] .. first[i] + n[i]."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Trainer:
    """Vectors, weights and the training windows; every step takes as many windows of toxic documents as of others."""

    def __init__(self, texts: list[str], label: np.ndarray):
        self.rng, self.label = np.random.default_rng(SEED), label
        starts, self.place, words, docs = numbered_words(texts)
        self.doc, self.first, self.end = (x.astype(np.int32) for x in window_bounds(starts))
        self.heads = np.searchsorted(self.doc, np.arange(len(texts)))
        self.words, self.common = words, docs >= LEAST_DOCS
        self.bucket, self.sizes = sorted_grams(words)
        self.misspell(np.zeros(len(words), bool))
        self.vectors = np.zeros((BUCKETS, WIDTH), np.float32)
        self.weights, self.bias = self.rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.square, self.square_w, self.square_b = np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def misspell(self, toxic: np.ndarray) -> None:
        """``toxic`` words of several documents are from now on also seen with a letter changed, in EDITS ways."""
        fresh = np.flatnonzero(self.common & toxic)
        self.form_at, self.forms = np.arange(len(self.words)), np.ones(len(self.words), np.int64)
        self.form_at[fresh], self.forms[fresh] = len(self.words) + np.arange(len(fresh)) * EDITS, EDITS
        bucket, sizes = sorted_grams([misspelt(self.words[w], self.rng) for w in fresh.tolist() for _ in range(EDITS)])
        own = self.sizes[: len(self.words)]
        self.bucket, self.sizes = np.concatenate([self.bucket[: own.sum()], bucket]), np.concatenate([own, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bag(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, row, share) of the n-grams of the given windows, some words misspelt, some n-grams left out."""
        row, at = spread(self.first[rows], (self.end - self.first)[rows])
        w = self.place[at]
        edited = self.rng.random(len(w)) < EDITED
        w = np.where(edited, self.form_at[w] + (self.rng.random(len(w)) * self.forms[w]).astype(np.int64), w)
        word, at = spread(self.starts[w], self.sizes[w])
        kept = self.rng.random(len(at)) >= DROPPED
        word, at = word[kept], at[kept]
        m = np.bincount(word, minlength=len(w))
        return self.bucket[at], row[word], (1 / (m[word] * WINDOW)).astype(np.float32)

    def step(self, rows: np.ndarray, target: np.ndarray) -> None:
        grams, row, share = self.bag(rows)
        mean = np.zeros((len(rows), WIDTH), np.float32)
        if len(grams):
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            mean[row[heads]] = np.add.reduceat(self.vectors[grams] * share[:, None], heads)
        logits = mean @ self.weights + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), target] -= 1
        p /= len(rows)
        to_mean, to_weights, to_bias = p @ self.weights.T, mean.T @ p, p.sum(0)
        self.square_w += to_weights**2
        self.square_b += to_bias**2
        self.weights -= RATE * to_weights / np.sqrt(self.square_w)
        self.bias = self.bias - RATE * to_bias / np.sqrt(self.square_b)
        if len(grams):
            order = np.argsort(grams, kind="stable")
            heads = np.flatnonzero(np.diff(grams[order], prepend=-1))
            step = np.add.reduceat((to_mean[row] * share[:, None])[order], heads)
            at = grams[order][heads]
            self.square[at] += (step**2).mean(1)
            self.vectors[at] -= RATE * step / np.sqrt(self.square[at])[:, None]

    def fit(self) -> None:
        """STEPS steps with the label of its document for every window."""
        self._run([np.flatnonzero(self.label[self.doc] == c).astype(np.int32) for c in (0, 1)], None)

    def refine(self) -> None:
        """STEPS more. Toxic are only those windows of toxic documents that the model so far finds toxic, and not
        much less than their document's worst; a quarter of the clean windows are their documents' worst."""
        now = self.window_logits()
        top = np.maximum.reduceat(now, self.heads)[self.doc]
        toxic = self.label[self.doc] == 1
        picked, clean = np.flatnonzero(toxic & (now > 0) & (now >= CLOSE * top)), np.flatnonzero(~toxic).astype(np.int32)
        del top, toxic
        if not len(picked):
            return
        self.misspell(self.word_scores() / WINDOW + self.bias[1] - self.bias[0] > 0)
        worst = clean[np.lexsort((-now[clean], self.doc[clean]))]
        place = np.arange(len(worst)) - np.searchsorted(self.doc[worst], self.doc[worst])
        self._run([clean, picked], worst[place < HARDEST])

    def _run(self, windows: list[np.ndarray], hard: np.ndarray | None) -> None:
        target = np.repeat([0, 1], BATCH // 2)
        draws, more = [self._by_document(w) for w in windows], None if hard is None else self._by_document(hard)
        for _ in range(STEPS):
            rows = np.concatenate([draw(BATCH // 2) for draw in draws])
            if more is not None:
                rows[: BATCH // 8] = more(BATCH // 8)
            self.step(rows, target)

    def _by_document(self, windows: np.ndarray) -> Callable[[int], np.ndarray]:
        """Draws from windows (ascending by document): a document first, then one of its windows, so long
        documents don't outweigh others."""
        begin = np.flatnonzero(np.diff(self.doc[windows], prepend=-1))
        count = np.diff(begin, append=len(windows))

        def draw(n: int) -> np.ndarray:
            docs = self.rng.integers(0, len(begin), n)
            return windows[begin[docs] + (self.rng.random(n) * count[docs]).astype(np.int64)]

        return draw

    def model(self) -> Model:
        return Model((self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))

    def word_scores(self) -> np.ndarray:
        n, table, found = len(self.words), self.model().bucket, [np.empty(0)]
        for at in range(0, n, WORDS_AT_ONCE):
            sizes = self.sizes[at : min(n, at + WORDS_AT_ONCE)]
            first = self.starts[at]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found.append(np.bincount(owner, table[self.bucket[first : first + len(owner)]], len(sizes)) / sizes)
        return np.concatenate(found)

    def window_logits(self) -> np.ndarray:
        return window_sums(self.word_scores(), self.place, self.first, self.end) / WINDOW + float(self.bias[1] - self.bias[0])

    def document_logits(self) -> np.ndarray:
        """Of every document the logit of its worst window."""
        return np.maximum.reduceat(self.window_logits(), self.heads)


def train(texts: list[str], label: np.ndarray) -> Model:
    """``label`` of each whole text: 0 or 1."""
    if len(set(label.tolist())) < 2:
        share = float(label[0]) if len(label) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 60.0 if share else -60.0)
    trainer = Trainer(texts, label)
    trainer.fit()
    for _ in range(ROUNDS):
        trainer.refine()
    found = trainer.model()
    return Model(found.bucket, found.bias - best_threshold(trainer.document_logits(), label))


def train_batches(batches: Iterator[pa.RecordBatch]) -> Model | None:
    """The model of (doc_id, label, text) in ascending doc_id; none without rows."""
    parts = list(batches)
    if not parts:
        return None
    rows = pa.Table.from_batches(parts).sort_by("doc_id")
    label, texts = rows["label"].to_numpy().astype(np.int64), rows["text"].to_pylist()
    del parts, rows
    return train(texts, label)


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the best weighted accuracy by class: a clean document
    that goes costs CLEAN_COUNTS times a toxic one that stays."""
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    stay = np.concatenate([[0], np.cumsum(label == 0)]) / max(1, (label == 0).sum())
    caught = 1 - np.concatenate([[0], np.cumsum(label == 1)]) / max(1, (label == 1).sum())
    right = CLEAN_COUNTS * stay + caught
    edges = np.concatenate([[score[0] - 1], score, [score[-1] + 1]])
    width = np.diff(edges)
    best = np.flatnonzero((right >= right[width > 0].max() - 1e-3) & (width > 0))
    at = best[np.argmax(width[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, left_out: tuple[int, ...] = (0,)) -> DataFrame:
    """(doc_id, label, text): the bounded sample of whole texts, without documents whose crc32(doc_id) modulo
    ``folds`` is in ``left_out``. Ids are chosen by their texts' sizes first, then only these texts are fetched."""
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~(crc32("doc_id") % folds).isin(*left_out))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(SAMPLE_DOCS).unionByName(known.where("label = 0").orderBy(*order).limit(SAMPLE_DOCS))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = id_text(docs).where(F.octet_length("text") <= SAMPLE_TEXT)
    # of rows that repeat an id the least text
    of = lambda ids: texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # noqa: E731  at most 2 x SAMPLE_DOCS ids
    sizes = of(chosen).select("doc_id", "label", F.octet_length("text").alias("bytes"))
    before = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.withColumn("bytes", F.sum("bytes").over(before)).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id", "label")
    return of(fitting)


def fit_model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, left_out: tuple[int, ...] = (0,)) -> Model:
    """Trains on the bounded sample, in one task: the driver only gets the model. Neither the order of rows nor how they are
    partitioned matters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", object)
        model = train_batches(batches)
        if model:
            yield batch_of(bucket=([model.bucket.astype("<f4").tobytes()], pa.binary()), bias=([model.bias], pa.float64()))

    found = training_sample(docs, labels, label_col, folds, left_out).coalesce(1).mapInArrow(run, "bucket binary, bias double").collect()
    return Model(np.frombuffer(found[0].bucket, "<f4"), found[0].bias) if found else train([], np.empty(0, np.int64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    caches: dict[int, Cache] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = caches.setdefault(0, Cache())
        logits = held.value.text_logits(batch.column("text"), cache)
        return batch_of(doc_id=(batch.column("doc_id"), None), score=(pa.array(sigmoid(logits)), None))

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, score double", "text")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = score(docs, fit_model(docs, labels, folds=folds))
    return found.select("doc_id", (crc32("doc_id") % folds == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, entries: int = CACHE_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose own text isn't judged toxic, with all their columns, whatever their names."""
    model = df.sparkSession.sparkContext.broadcast(fit_model(id_text(df, id_col, text_col), labels))  # BUCKETS floats
    caches: dict[int, Cache] = {}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    text = f"c{df.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", object)
        for part in slices(batches, text):
            logits = model.value.text_logits(pc.fill_null(part.column(text), ""), caches.setdefault(0, Cache(entries)))
            yield part.filter(pa.array(sigmoid(logits) < 0.5))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
