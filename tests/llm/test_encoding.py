"""Byte-level BPE, packed ids: against the tokenizer libraries and by round trips."""

import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalweave.llm import bpe, common, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from(" \n\t'sldvremt  aAbZ19é中ß\x1c\x85\xa0!?.,-😀"), max_size=60)
RELAXED = settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
TEXTS = [(3, "Hello  world, it's \n\n fine"), (1, None), (2, ""), (5, "x" * 5000 + " " * 300 + "y"), (4, "Hello  world, it's \n\n fine"), (None, "no id"), (9, "é" * 40), (9, "é" * 40)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.PrefixBPE(bpe.load_ranks(RANKS)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def judge():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@RELAXED
@given(TEXT)
def test_same_ids_as_library(encoder, judge, text):
    ids = encoder.encode(text).tolist()
    assert ids == judge.encode_ordinary(text)
    assert encoder.encoder.decode(ids).decode() == text


@RELAXED
@given(st.binary(min_size=1, max_size=40))
def test_every_prefix_is_encoded(encoder, judge, data):
    """The array of last tokens holds the encoding of each prefix."""
    last = encoder.encoder.extend(data, [])
    for end in range(1, len(data) + 1):
        assert encoder.encoder.tokens_of(last, end) == encoder.encoder._merge(data[:end])
    (joined,) = encoder.encoder.encode_pieces([data])
    assert joined == encoder.encoder.encode_piece(data)


@RELAXED
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), TEXT), max_size=5))
def test_edits_and_appends(encoder, judge, text, edits):
    held = bpe.EditableEncoding(encoder.encoder, public_tokenizers.PATTERN, text)
    for at, cut, new in edits:
        at = min(at, len(held.text))
        held.replace(at, min(len(held.text), at + cut), new[:8])
        assert held.ids() == judge.encode_ordinary(held.text)
    held.append(" end's")
    assert held.ids() == judge.encode_ordinary(held.text)


def test_edit_keeps_far_pieces(encoder):
    held = bpe.EditableEncoding(encoder.encoder, public_tokenizers.PATTERN, "some words " * 200)
    pieces = len(held.pieces)
    held.replace(1000, 1003, "abc")
    assert held.reused > 0.95 * pieces


def test_small_caches_give_the_same(encoder, judge, monkeypatch):
    from evalweave.llm import words

    small = bpe.TextEncoder(encoder.encoder, public_tokenizers.PATTERN)
    for cache in (small._words, small._heads, small._pieces):
        cache.entries = 3
    for i in range(40):
        text = f"a{i} b{i % 5} c, dé{i} a1 {words.KEPT_LENGTH * 'z'}{i}"
        assert small.encode(text).tolist() == judge.encode_ordinary(text)


def test_digests_of_texts(spark, judge):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encoding_digests(df, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = judge.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    decoded = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_documents(encoded, RANKS).collect()}
    assert decoded[3] == TEXTS[0][1] and decoded[1] == ""
    assert bpe.encoding_digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@RELAXED
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32))
def test_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-n * bits // 8) and (packing.unpack(data, n, bits) == ids).all()
    value = sum(int(x) << (bits * i) for i, x in enumerate(ids))
    assert int.from_bytes(data, "little") == value


def test_random_access():
    ids = np.random.default_rng(0).integers(0, 50257, 10_001).astype(np.uint32)
    held = packing.PackedFile(packing.file_bytes(np.arange(3), np.array([1, 5000, 5000]), ids, packing.bits_for(50257)))
    for a, b in ((0, 0), (0, 1), (4095, 4097), (9990, 10_001), (0, 10_001)):
        assert (held.ids(a, b) == ids[a:b]).all()


def test_packed_files(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    texts = [*TEXTS, (6, "a<|endoftext|> b <|endoftext|>")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    got = sorted(map(tuple, packing.packed_round_trip(df, JSON, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    rows = packing.read_packed(spark, f"file://{tmp_path}/ids").orderBy("bucket", "part", "position").collect()
    assert [zlib.crc32(r.ids) for r in rows] == [w[3] for w in want]
    assert packing.packed_round_trip(df.limit(0), JSON, f"file://{tmp_path}/none").count() == 0


def test_files_are_bounded_and_a_hot_id_is_spread(spark, tmp_path):
    library, words = Tokenizer.from_file(JSON), "alpha beta gamma delta epsilon".split()
    rows = [(None, f"{words[i % 5]} {i}") for i in range(300)] + [(7, f"{words[i % 3]} {i} " * 3) for i in range(300)] + [(i, "w " * (i % 40)) for i in range(300)] + [(9000, "x y " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = packing.packed_round_trip(df, JSON, f"file://{tmp_path}/ids", file_ids=200).collect()
    names = sorted(p.name for p in (tmp_path / "ids").glob("ids-*.bits"))
    assert len(names) > 40 and max(p.stat().st_size for p in (tmp_path / "ids").glob("ids-*") if p.stat().st_size < 5000) < 4096
    held = packing.read_packed(spark, f"file://{tmp_path}/ids").collect()
    assert len({(r.bucket) for r in held if r.doc_id is None}) > 1 and len({r.bucket for r in held if r.doc_id == 7}) > 1
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in found) == want
    whole = packing.packed_round_trip(df, JSON, f"file://{tmp_path}/one").collect()
    assert sorted(map(str, whole)) == sorted(map(str, found))


def test_ids_are_made_without_searches_for_cycles():
    """The worker's collector is off while a batch is encoded, and on again afterwards, also after an error."""
    import gc

    with pytest.raises(KeyError), packing.no_collections():
        assert not gc.isenabled()
        raise KeyError
    assert gc.isenabled()


def test_words_that_differ_by_marks_share_their_runs():
    """Each run of letters goes to the model once, and only words that aren't such runs go through the library's whole chain."""
    path, tokens, chain = public_tokenizers.path("byte_bpe_50k.json"), [], []
    tokenizer = packing.WordTokenizer(path)
    runs, any_ = tokenizer._encode_runs, tokenizer._encode_any
    tokenizer._encode_runs = lambda fresh: tokens.extend(fresh) or runs(fresh)
    tokenizer._encode = tokenizer._encode_any = lambda words: chain.extend(words) or any_(words)
    texts = ["an übel, übel. übel!\nübel (übel) übel", "an don't <|endoftext|> a\n\nb 中 x\n"]
    assert [x.tolist() for x in tokenizer.encode_batch(texts)] == [x.ids for x in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sorted(t for t in tokens if "übel" in t) == [" übel", "übel"]
    assert sorted(chain) == [" <|endoftext|>", " a\n\nb", " don't", " x\n", " 中", "an"]
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ9*&.,;:!?\n  \t'séßÄяع中<|>　́\rᲐ͸") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [x.tolist() for x in tokenizer.encode_batch(texts)] == [x.ids for x in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_stage_drops_what_the_one_before_kept():
    """A worker that goes from encoding to another stage frees the encoder with its caches; within a stage it keeps it."""
    encoder = bpe._encoder(RANKS, public_tokenizers.PATTERN, 100)
    assert bpe._encoder(RANKS, public_tokenizers.PATTERN, 100) is encoder
    kept = weakref.ref(encoder)
    del encoder
    common.held("another stage", object)
    assert kept() is None
