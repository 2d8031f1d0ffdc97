"""Which chunks of a text toxicity reads, against reading all of them."""

import random
from collections import Counter
from itertools import chain

import numpy as np

from lingoscope.llm import toxicity

LETTERS = [*"aeinorstx", "th", "idiot", "Id", "IOT", *"éÉßœæÆİÅﬁ漢字е34078$@!|(+€.-_*'`~ªð×", "K", "́", "​"]
BLANKS = [" "] * 12 + [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def reader(*features):
    text = "you are such an idiot and the others are worthless " * 20
    log4 = toxicity.log_model(toxicity.gram_counts(np.frombuffer(text.encode(), np.uint8)))
    return toxicity.Reader(toxicity.Model(log4, dict.fromkeys(features, 1.0), -1.0))


def plain_hits(r, text):
    chunks = text.split()
    words = set(chain.from_iterable(map(r._read, [*chunks, *toxicity.spaced_out(chunks)])))
    return Counter(f for w in words for f in r.shown[w])


def test_hits_as_of_every_chunk():
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS if rng.random() < share else BLANKS) for _ in range(rng.randrange(60))) for share in (0.5, 0.75, 0.9) for _ in range(700)]
    r = reader("idiot", "iot", "the*", "thei*", "eee", "ssa", "ana*", "kid*")
    got = r.hits(texts)
    assert got == [plain_hits(r, t) for t in texts] and sum(map(len, got)) > 300
    assert r.hits([]) == [] and r.hits(["", " "]) == [Counter(), Counter()]


def test_plain_words_are_not_read(monkeypatch):
    r, read = reader("idiot", "worth*"), []
    one = r._read
    monkeypatch.setattr(r, "_read", lambda chunk: read.append(chunk) or one(chunk))
    assert r.hits(["Été, the others: (worn) idiom. an 1d10t -- the worthless i d i o t"]) == [Counter(["idiot", "worth*"])]
    assert set(read) == {"(worn)", "idiom.", "1d10t", "worthless", "i d i o t"}
