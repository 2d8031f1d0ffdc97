"""What a worker keeps of the chunks it has met."""

from lingoscope.llm import tokens
from lingoscope.llm.queries import tokenizer_path


def test_a_full_memo_keeps_what_is_needed_now(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 8)
    bpe = tokens.Bpe(tokenizer_path())
    texts = ["Zork zork ABC it's qxzv, x1y zyxwv", "zork abcq Zork qxzv, it's QXZVK", "a b c d e f g h i zork jklmn", "Éa <|x|> ﬁ zork", "ZORK " + "qx" * 200]
    want = [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    asked, resolve = [], bpe._resolve
    monkeypatch.setattr(bpe, "_resolve", lambda chunks: asked.append(set(chunks)) or resolve(asked[-1]))
    for text, ids in zip(texts, want):
        assert bpe.ids([text])[0].tolist() == ids, text
        assert len(bpe.memo) <= 8
    assert asked[1] == {"abcq", "QXZVK"}  # the memo was full, and the rest of this text was in it
