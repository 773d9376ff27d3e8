import random

import public_tokenizers as P
import pytest
import tiktoken

from adjudex.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH, P.PATTERN)


def test_same_tokens_as_the_library(encoder, reference):
    draw = random.Random(3)
    units = ["a", "ab", "the", "   ", "\n\n", "aaaa", "====", "0", "ing", "é", "中", "😀", "\t", "'ll", "\x85", "\x1c", "\x00", "ß", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(draw.choice(units) for _ in range(draw.randint(0, 40)))
        assert encoder.encode(text).tolist() == reference.encode_ordinary(text)
    assert encoder.encode("a" * 50_000).tolist() == reference.encode_ordinary("a" * 50_000)


def test_a_full_table_changes_nothing(reference):
    small = byte_bpe.Encoder(PATH, P.PATTERN)
    small.transducer.max_states, small.pieces.size = 20, 3
    text = "The quick brown foxes jumped over thirteen extraordinarily lazy hippopotamuses. " * 3
    assert small.encode(text).tolist() == reference.encode_ordinary(text)
    draw = random.Random(5)
    for letters in ("abcdefgh", "中文字é😀ab", "="):
        # One piece of many spans, whose states the full table does not keep.
        text = "".join(draw.choice(letters) for _ in range(3 * byte_bpe.SPAN))
        assert small.encode(text).tolist() == reference.encode_ordinary(text)
    assert len(small.transducer._guesses) < 3 * byte_bpe.SPAN


def test_streaming_decode():
    draw = random.Random(4)
    for _ in range(500):
        data = bytes(draw.randrange(256) for _ in range(12))
        machine = byte_bpe.Utf8Machine()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close() == data.decode("utf-8", "replace")
    decoder = byte_bpe.Decoder(PATH)
    ids = byte_bpe.Encoder(PATH, P.PATTERN).encode("naïve 中文 😀!").tolist()
    assert "".join(decoder.decode_stream([i] for i in ids)) == "naïve 中文 😀!"


def test_other_patterns():
    assert byte_bpe.ascii_pattern(P.PATTERN) and byte_bpe.ascii_pattern(r"\p{Lu}+|\s") is None


def test_frames(spark, odd, empty, reference):
    got = byte_bpe.decode(byte_bpe.encode(odd, PATH, P.PATTERN).withColumnRenamed("text", "original"), PATH, out_col="text").collect()
    assert len(got) == 10 and all(r["text"] == (r["original"] or "") for r in got)
    assert byte_bpe.round_trip_digests(empty, PATH, P.PATTERN).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(odd, PATH, P.PATTERN).collect()}
    assert ids[1] == [] and ids[4] == reference.encode_ordinary("one")
