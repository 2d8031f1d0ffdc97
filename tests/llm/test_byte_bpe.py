import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from cases import awkward, table

from lingoscope.llm import byte_bpe

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def merges(tokens):
    return byte_bpe.compile_merges(tokens)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def ids_of(encoder, text):
    return list(memoryview(encoder.packed(text)).cast("H"))


ALPHABET = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "\r\n", "é", "日", "本", "😀", "1", "23", "'s", "'", "!", "--", "　", "\xa0", "\x1c", "\x85", "x", "Z", "ß", "ж", "<|endoftext|>"]


def test_random_texts_as_the_library(merges, library):
    rng, encoder = random.Random(3), byte_bpe.Encoder(merges, PATTERN)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [bytes(rng.randrange(256) for _ in range(200)).decode("latin1") for _ in range(50)]
    assert [ids_of(encoder, t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_small_bounds_change_nothing(merges, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 5)
    rng, encoder = random.Random(5), byte_bpe.Encoder(merges, PATTERN, memo_bytes=100)
    encoder.machine.most_states, encoder.machine.settle = 20, 7
    texts = ["".join(rng.choice(ALPHABET) for _ in range(60)) for _ in range(300)] + ["".join(rng.choice("abcdefgh") for _ in range(3000)), "a" * 5000]
    assert [ids_of(encoder, t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def plain(tokens, data):
    """Merging by ranks, a pair at a time."""
    rank, parts = {t: i for i, t in enumerate(tokens)}, [bytes([b]) for b in data]
    if data in rank:
        return [rank[data]]
    while len(parts) > 1:
        best = min((rank.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [rank[p] for p in parts]


def test_other_vocabularies_merge_as_the_plain_way():
    rng = random.Random(11)
    for _ in range(150):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(rng.randrange(1, 25)):  # each is made of two that are there already
            new = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if new not in tokens and plain(tokens, new) and len(plain(tokens, new)) == 2:
                tokens.append(new)
        machine = byte_bpe.Transducer(byte_bpe.compile_merges(tokens), settle=rng.choice([3, 1000]))
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            assert machine.ids(data) == plain(tokens, data)


def test_letters_alone_are_one_match():
    letters = regex.compile(r"\p{L}")
    assert all(letters.match(c) for c in map(chr, range(0x110000)) if c.isalpha())


def test_streaming_decoder(tokens):
    rng = random.Random(7)
    one = {t: i for i, t in enumerate(tokens) if len(t) == 1}
    whole, raw = byte_bpe.Decoder(tokens, replace=True), byte_bpe.Decoder(tokens)
    for _ in range(3000):
        data = bytes(rng.choice([rng.randrange(256), 0xE2, 0x80, 0xF0, 0xED, 0xA0, 0xC3, 0xF4, 0x90]) for _ in range(rng.randrange(40)))
        got, kept, at = b"", b"", 0
        while at < len(data):
            step = rng.randrange(1, 6)
            ids = [one[data[k : k + 1]] for k in range(at, min(len(data), at + step))]
            part = whole.feed(ids)
            part.decode()  # ends with a whole character
            got, kept, at = got + part, kept + raw.feed(ids), at + step
        assert got + whole.close() == data.decode("utf-8", "replace").encode() and kept + raw.close() == data


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trips(spark, tokens, library, monkeypatch):
    out = byte_bpe.round_trips(table(spark), tokens, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((r[0], *expected(library, r[1]))) for r in awkward())
    assert byte_bpe.round_trips(table(spark, []), tokens, PATTERN).count() == 0


def test_encoded_and_decoded(spark, tokens, library):
    rows = byte_bpe.encoded(table(spark), tokens, PATTERN)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in rows.collect()) == sorted(repr((r[0], library.encode_ordinary(r[1] or ""))) for r in awkward())
    back = byte_bpe.decoded(rows, tokens).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((r[0], r[1] or "")) for r in awkward())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [tokens.index(b"\xe2"), tokens.index(b"a")])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decoded(odd, tokens).collect()} == {1: None, 2: "", 3: "�a"}
