"""SentencePiece codec against the library, and packing against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import kernel, packing, sentencepiece_codec
from deltaweave.llm.queries import tokenizer_file

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

PIECES = tokenizer_file("piece_bpe_32k.model")
BYTES = tokenizer_file("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    alphabet = "ab the▁ \n\t  éß漢字🧿\x00\x1c\x85\xa0 in er '\"!#12's"
    odd = ["", " ", "  ", "\n", " " * 50, "a" * 3000, "漢字かな" * 400, "the" * 500, " " * 900 + "x", "▁▁x ▁", "⁇", "</s> <s> <0x0A>", "<|endoftext|>x", "é \n b", "word\n  next"]
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [" ".join(rng.choice(["the", "tion", "Übung", "x1", "don't"]) for _ in range(5000))]


def documents(spark, values, extra=False):
    rows = [(i, t, "c", i) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids int").repartition(3)


def test_encoding_and_decoding_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    values = [*texts(), None, "twice", "twice"]
    got = {r.doc_id: r for r in sentencepiece_codec.encode_decode(documents(spark, values), PIECES).collect()}
    assert len(got) == len(values)
    for i, text in enumerate(values):
        want = [*library.encode(text or ""), library.eos_id()]
        assert got[i].ids == want, text
        assert got[i].decoded == library.decode(want), text


def test_digests(spark):
    row = sentencepiece_codec.digests(sentencepiece_codec.encode_decode(documents(spark, ["a b"]), PIECES)).first()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [*library.encode("a b"), 2]
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_decoding_any_ids_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepiece_codec.PieceModel(PIECES)
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 28705, 259, rng.randint(3, 258), rng.randint(260, 31999)]) for _ in range(rng.randint(0, 6))]
        assert model.decode_flat(np.array(ids, dtype=np.int32), np.array([0, len(ids)]))[0].as_py() == library.decode(ids), ids


def test_words_without_spaces_of_any_length():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepiece_codec.PieceModel(PIECES)
    rng = random.Random(11)
    prose = "".join(rng.choice(["the", "ing", "quality", "Straße", "ab", "aa", "tion", "x", "zz", "\n", "漢"]) for _ in range(20_000))
    words = [" " + "".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aab", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "0123456789abcdef", "aé漢\n") for n in (3, 17, 18, 40, 400, 4000) for _ in range(4)]
    words += [" " + prose, " internationalisation", " abcabcabcabc", " zzzzzz", " a", " " + "a" * 100_001, " " * 777 + "x", " " + "=" * 5001, " " + "abc" * 9999]
    ids, sizes = model.encode_words([w.encode() for w in words])
    for word, size, end in zip(words, sizes, np.cumsum(sizes), strict=True):
        assert ids[end - size : end].tolist() == library.encode(word[1:]), word[:60]


def test_store_survives_being_emptied():
    store = kernel.ChunkStore(lambda chunks: (np.array([len(c) for c in chunks], dtype=np.int32), np.ones(len(chunks), dtype=np.int64)), limit=5)
    for k in range(40):
        text = " ".join(f"{k}{'x' * j}" for j in range(9)).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        cuts = np.r_[0, np.flatnonzero(data == 32)]
        values, sizes = store.gather(data, cuts, np.r_[cuts[1:], len(data)])
        assert values.tolist() == np.diff(np.r_[cuts, len(data)]).tolist() and sizes.sum() == 9


def test_packing_covers_every_token_once(spark):
    tokenizer = tokenizers.Tokenizer.from_file(BYTES)
    special = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x <|endoftext|>\n", "a <|endof text|>  <|endoftext|><|endoftext|>.", "\n\n<|endoftext|>  y", "<|endoftext|" * 3 + ">"]
    long = ["x" + " " * 1_200_000, "\n" * 300_000 + "y", "a " + "\t \n" * 200_000 + " b c", "q" * 300_000, "?!" * 100_000, "é" * 5000 + " x"]
    values = [*texts(), None, "twice", "twice", *special, *long]
    want = {i: [*e.ids, 0] for i, e in enumerate(tokenizer.encode_batch([t or "" for t in values], add_special_tokens=False))}
    pieces = packing.digests(packing.pack(documents(spark, values), BYTES, block_tokens=4000)).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(want[doc])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_best_fit_equals_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        capacity = rng.choice([1, 7, 16, 64, 1000, 1024])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 80))], dtype=np.int64)
        window, offset, count = packing.best_fit_decreasing(lengths, capacity)
        rooms: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in rooms if r >= lengths[i]]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            rooms.append(room - int(lengths[i]))
        assert count == len(rooms)
        filled = np.bincount(window, weights=lengths, minlength=count) if count else np.zeros(0)
        assert sorted(capacity - filled) == sorted(rooms)


def test_padding_is_little(spark, sf_dir):
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTES)
    got = pieces.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert got.n / (1024 * got.s) > 0.97


def test_empty_tables(spark):
    empty = documents(spark, ["x"]).limit(0)
    assert sentencepiece_codec.encode_decode(empty, PIECES).count() == packing.pack(empty, BYTES).count() == 0
