"""Token ids as files of fixed-width bits.

Documents are dealt to ranges of doc_id, and a range's documents are written in ascending order to files of
bounded size: a new one starts where the next document would bring a file over FILE_IDS ids (a longer document
has a file of its own). So neither files nor what a task holds grow with the data. A file's parts, all little-endian:

- header: magic ``EWBITS01``, then unsigned 64-bit bits per id, ids per block, documents, ids, blocks
- documents x int64: doc_id (a null id is stored as the smallest int64)
- documents x uint64: ids of the document, its end id included
- blocks x uint64: byte offset of each block in the payload
- payload: blocks of packed ids; an id's lowest bit comes first, and each block starts at a byte

An id takes the fewest bits that hold the vocabulary. Ids are packed and unpacked lane by lane with
numpy; any range of ids can be read from its own blocks only.

Files are written by the tasks under a name that only depends on their range and its part, first under a temporary
name and then renamed, so a task that runs again after a lost executor replaces its file with an equal one.

Defined cases: a null text counts as empty and an empty text holds just its end id; repeated doc_ids keep
one entry each, ordered by a hash of their text, then by the text; null doc_ids come first; an empty table writes no file and
reads back as an empty table; other columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import json
import math
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, checkpoint_dir, id_text, materialise, slices
from .ordered import BUCKET, add_bucket, shuffle_width, tie_hash
from .words import WordEncoder, gathered, id_bytes

MAGIC, HEADER, BLOCK_IDS = b"EWBITS01", struct.Struct("<8s5Q"), 4096
#: Ids of a file: 16 MB at 16 bits.
FILE_IDS = 1 << 23
NULL_ID = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each. The fewest ids that fill whole words make a group, and each lane of a group
    is placed for all groups at once."""
    common = math.gcd(bits, 64)
    lanes_of, words_of = 64 // common, bits // common
    groups = -(-len(ids) // lanes_of)
    lanes = np.zeros((groups, lanes_of), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, words_of), np.uint64)
    for lane in range(lanes_of):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    common = math.gcd(bits, 64)
    lanes_of, words_of = 64 // common, bits // common
    groups = -(-n // lanes_of)
    words = np.frombuffer(data.ljust(groups * words_of * 8, b"\0"), "<u8")[: groups * words_of].reshape(groups, words_of)
    lanes, mask = np.empty((groups, lanes_of), np.uint32), np.uint64((1 << bits) - 1)
    for lane in range(lanes_of):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[:n]


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A whole file of the documents with the given ids, one after the other."""
    blocks = [pack(ids[at : at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    header = HEADER.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks))
    return b"".join([header, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class PackedFile:
    """A view of one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, docs, self.n_ids, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 16 * docs).astype(np.int64)
        self._data, self._payload = data, at + 16 * docs + 8 * blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], read from the blocks that hold them; whole blocks are unpacked."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        begin = first * self.block_ids
        count = min((last + 1) * self.block_ids, self.n_ids) - begin
        at = self._payload + self.offsets[first]
        end = self._payload + self.offsets[last + 1] if last + 1 < len(self.offsets) else len(self._data)
        return unpack(bytes(self._data[at:end]), count, self.bits)[start - begin : stop - begin]



#: What stands between words that are encoded together, and how many are.
TAB, JOINED = "\t", 256
#: Kinds of characters that the splitter keeps in runs; an apostrophe starts contractions and ``<`` a special token, so they are OTHER, as
#: is everything from PLAIN on.
OTHER, LETTER, DIGIT, MARK, LINE = range(5)
MARKS, PLAIN = "".join(sorted({*string.punctuation} - {*"'<"})), 0x2000


class WordTokenizer(WordEncoder):
    """A byte-level file of the ``tokenizers`` library over whole texts.

    Most words are runs of letters, digits and marks, which the splitter cuts where the kind changes, in any text. Words that differ
    by marks share their runs, and each distinct run goes to the library's model once; other words go through its whole chain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._encode_any, 600_000)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        (self._tab,) = self.tokenizer.encode(TAB, add_special_tokens=False).ids
        self._model, self._kinds = self.tokenizer.model, self._kinds_of_characters()
        # the byte-level alphabet: printable bytes of Latin-1 stand for themselves, others for the code points from 256 on
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        free = iter(range(0x100, 0x200))
        self._alphabet = "".join(chr(b if b in own else next(free)) for b in range(256))

    def _kinds_of_characters(self) -> np.ndarray | None:
        """The kind of each code point up to PLAIN, letters as the library's own splitter tells them; none if the file isn't plainly byte-level."""
        made = json.loads(self.tokenizer.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout"):
            return None
        some = [c for c in map(chr, range(PLAIN)) if c.isalpha()]
        pieces = {at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(TAB.join(f"a{c}a" for c in some))}
        kinds = np.full(PLAIN + 1, OTHER, np.uint8)
        kinds[[ord(c) for i, c in enumerate(some) if (4 * i, 4 * i + 3) in pieces]] = LETTER
        for characters, kind in ((string.digits, DIGIT), (MARKS, MARK), ("\n", LINE)):
            kinds[[*map(ord, characters)]] = kind
        plain = lambda text: all(c == " " or kinds[min(ord(c), PLAIN)] != OTHER for c in text)
        return None if any(plain(t["content"]) for t in made["added_tokens"]) else kinds

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Each run is one piece of the splitter: its bytes in the library's alphabet go to its model."""
        if not runs:
            return []
        spelt = codecs.charmap_decode(TAB.join(runs).encode(), "strict", self._alphabet)[0].split(self._alphabet[ord(TAB)])
        return id_bytes([[t.id for t in self._model.tokenize(run)] for run in spelt])

    def _word_table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._kinds is None or not len(words):
            return super()._word_table(words)
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
        points = np.frombuffer(bytes(data[ends[0] : ends[-1]]).decode().encode("utf-32-le"), np.uint32)
        at = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int32) + ends[0]
        at = np.concatenate([ends[:1], at])
        kind, starts = self._kinds[np.minimum(points, PLAIN)], np.zeros(len(points), bool)
        starts[np.searchsorted(at, ends[:-1])] = True
        run = np.flatnonzero(starts | (np.diff(kind, prepend=OTHER) != 0))
        first, word = starts[run], np.cumsum(starts[run]) - 1
        # a line's end is a piece of its own if it is a single one before other characters of the word
        line = (kind[run] == LINE) & ((np.diff(run, append=len(points)) > 1) | first | np.append(first[1:], True))
        odd = np.zeros(len(words), bool)
        odd[word[(kind[run] == OTHER) | line]] = True
        plain = ~odd[word]
        texts = pa.StringArray.from_buffers(len(run), pa.py_buffer(at[np.append(run, len(points))].astype(np.int32)), data)
        lead, rest = (texts.filter(pa.array(plain & x)).dictionary_encode() for x in (first, ~first))
        leads, rests = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (lead, rest))
        values = self._words.recall(leads, lambda fresh: self._encode_runs([" " + r for r in fresh])) + self._heads.recall(rests, self._encode_runs)
        values += self._after_space(words.filter(pa.array(odd)).to_pylist())
        # an odd word is one unit, at its first run
        code = np.zeros(len(run), np.int64)
        code[plain & first], code[plain & ~first] = lead.indices.to_numpy(), rest.indices.to_numpy() + len(leads)
        code[~plain & first] = len(leads) + len(rests) + np.arange(odd.sum())
        unit = plain | first
        table, sizes = gathered(values, code[unit])
        return table, np.add.reduceat(sizes, np.flatnonzero(first[unit]))

    def _encode_any(self, words: list[str]) -> list[bytes]:
        """Words with a space before them share long strings, with a tabulator between each two: white space
        that the library's splitter makes a piece of its own there. What holds white space elsewhere, or the
        text of a special token, is encoded by itself."""
        alone = [not w.startswith(" ") or w[1:].split() != [w[1:]] or "<|" in w for w in words]
        out = [b""] * len(words)
        joined = [i for i, x in enumerate(alone) if not x]
        groups = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for group, found in zip(groups, self._ids([TAB.join(words[i] for i in group) for group in groups]), strict=True):
            ids = np.array(found, "<u4")
            ends = np.append(np.flatnonzero(ids == self._tab), len(ids)).tolist()
            data, at = ids.tobytes(), 0
            for i, end in zip(group, ends, strict=True):
                out[i] = data[4 * at : 4 * end]
                at = end + 1
        single = [i for i, x in enumerate(alone) if x]
        for i, value in zip(single, id_bytes(self._ids([words[i] for i in single])), strict=True):
            out[i] = value
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def _tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = WordTokenizer(path)
    gc.collect()
    gc.freeze()
    return made


@contextmanager
def no_collections() -> Iterator[None]:
    """No search for cycles inside, which the many short lists of ids would start again and again; they have none and go by their counts."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def write_packed(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the files under ``folder`` (a URI that pyarrow
    and Spark can both reach). Returns (bucket, part, path, n_docs, n_ids), a row for each file, after writing."""
    marked = add_bucket(id_text(df, id_col, text_col), "doc_id", 4 * shuffle_width(df), "text")
    dealt = marked.repartition(BUCKET).sortWithinPartitions(BUCKET, F.col("doc_id").asc_nulls_first(), tie_hash("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tail = _tokenizer(tokenizer_path), np.uint32(end_id)
        bits = bits_for(max(tokenizer.vocabulary, end_id + 1))
        now, part, held, docs, encoded = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            lengths = np.array(list(map(len, encoded)), np.int64)
            ids = np.concatenate(encoded)
            path = save(folder, f"ids-{now:06d}-{part:06d}.bits", file_bytes(np.array(docs, np.int64), lengths, ids, bits))
            return batch_of(bucket=([now], pa.int32()), part=([part], pa.int32()), path=([path], pa.string()), n_docs=([len(docs)], pa.int64()), n_ids=([len(ids)], pa.int64()))

        for piece in slices(batches, "text"):
            with no_collections():
                made = tokenizer.encode_batch(piece.column("text"))
            for bucket, doc, ids in zip(piece.column(BUCKET).to_pylist(), piece.column("doc_id").to_pylist(), made, strict=True):
                if docs and (bucket != now or held + len(ids) + 1 > file_ids):
                    yield flush()
                    part, held, docs, encoded = part + 1, 0, [], []
                if bucket != now:
                    now, part = bucket, 0
                docs.append(NULL_ID if doc is None else doc)
                encoded.append(np.append(ids, tail))
                held += len(ids) + 1
        if docs:
            yield flush()

    return dealt.mapInArrow(run, "bucket int, part int, path string, n_docs long, n_ids long")


def save(folder: str, name: str, data: bytes) -> str:
    """Writes under a name of its own and renames, so that a file is there whole or not at all."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, f"{path}/{name}")
    return f"{folder}/{name}"


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, part, position, doc_id, local_start, ids binary as little-endian uint32) of every document; position
    and local_start count within its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                packed, (bucket, number) = PackedFile(content), file_place(path)
                ends = np.cumsum(packed.lengths)
                for at in range(0, len(ends), 256):
                    to = min(at + 256, len(ends))
                    base = int(ends[at] - packed.lengths[at])
                    ids = packed.ids(base, int(ends[to - 1]))
                    cuts = [(int(ends[i] - packed.lengths[i]) - base, int(ends[i]) - base) for i in range(at, to)]
                    yield batch_of(
                        bucket=([bucket] * (to - at), pa.int32()),
                        part=([number] * (to - at), pa.int32()),
                        position=(list(range(at, to)), pa.int64()),
                        doc_id=([None if d == NULL_ID else int(d) for d in packed.doc_ids[at:to]], pa.int64()),
                        local_start=([base + a for a, _ in cuts], pa.int64()),
                        ids=([ids[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary()),
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bits").load(folder)
    return files.select("path", "content").mapInArrow(run, "bucket int, part int, position long, doc_id long, local_start long, ids binary")


def digest_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, part, doc_id, local_start, n_tokens, ids_crc32) from the files' own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                packed, (bucket, number) = PackedFile(content), file_place(path)
                ends = np.cumsum(packed.lengths)
                starts = ends - packed.lengths
                crc = []
                for at in range(0, len(ends), 256):
                    to, base = min(at + 256, len(ends)), int(starts[at])
                    ids = packed.ids(base, int(ends[to - 1])).astype("<u4")
                    crc += [zlib.crc32(ids[a - base : b - base]) for a, b in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)]
                yield batch_of(
                    bucket=([bucket] * len(ends), pa.int32()),
                    part=([number] * len(ends), pa.int32()),
                    doc_id=([None if d == NULL_ID else int(d) for d in packed.doc_ids], pa.int64()),
                    local_start=(starts.tolist(), pa.int64()),
                    n_tokens=(packed.lengths.tolist(), pa.int64()),
                    ids_crc32=(crc, pa.int64()),
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bits").load(folder)
    return files.select("path", "content").mapInArrow(run, "bucket int, part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def file_place(path: str) -> tuple[int, int]:
    """Range and part from a file's name."""
    bucket, part = path.rpartition("/")[2].removeprefix("ids-").removesuffix(".bits").split("-")
    return int(bucket), int(part)


def file_starts(written: DataFrame) -> DataFrame:
    """(bucket, part, start): ids of all files before. Parts are summed within their range, and ranges' totals,
    of which there is a set number, in one order."""
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written.groupBy("bucket").agg(F.sum("n_ids").alias("all")).select("bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    inside = written.select("bucket", "part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("inside"))
    return inside.join(ranges, "bucket").select("bucket", "part", (F.col("ahead") + F.col("inside")).alias("start"))


def packed_round_trip(df: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): writes all documents and reads the files back.

    The files go to a fresh folder under the cluster's shared one unless ``folder`` is given.
    """
    spark = df.sparkSession
    folder = folder or shared_uri(f"{checkpoint_dir(spark)}/packed-{uuid.uuid4().hex}")
    written = materialise(write_packed(df, folder, tokenizer_path, end_id, file_ids=file_ids).select("bucket", "part", "n_ids"))
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row for each file, so about a millionth of the data; Spark chooses how to join it by its size
    found = digest_packed(spark, folder).join(file_starts(written), ["bucket", "part"])
    return found.select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def shared_uri(path: str) -> str:
    """A folder as a URI; a plain path is a mounted file system."""
    return path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"
