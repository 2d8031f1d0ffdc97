"""Chunks that Arrow finds are those of the tokenizer."""

import sys

import pyarrow as pa

from lingoscope.llm import tokens
from lingoscope.llm.queries import tokenizer_path


def test_arrow_splits_texts_at_the_same_characters():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for some in ([c for c in every if c not in tokens.UNLIKE], list(tokens.UNLIKE)):
        texts = [f"{c}a{c}{c}b{c}" for c in some]
        bounds, numbers, chunks = tokens.numbered_chunks(pa.array([*texts, None, ""]))
        found = [[c for c in (chunks[n] for n in numbers[a:b]) if c] for a, b in zip(bounds, bounds[1:])]
        assert found == [*map(tokens.chunks_of, texts), [], []]


def test_ids_of_a_column_with_letters_and_signs():
    own = tokens.Bpe(tokenizer_path())
    texts = [None, "Été, it's 'tis don't. x<|y <|endoftext|> ,,, Straße!? İz z'İ ŁÓDŹ... ×÷ a×b ª.º", " \t", "", "qzxv qzxv, Qzxv. QZXV?! 'S 's. n'T"] * 2
    want = [e.ids for e in own.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.array(["before", *texts]).slice(1)
    assert [x.tolist() for x in own.ids(column)] == want
    assert own.counts(column) == list(map(len, want))
    assert own.ids(pa.array([], pa.string())) == own.ids([]) == [] and own.ids([""])[0].tolist() == []
