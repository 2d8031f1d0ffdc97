import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from cases import awkward, table

from lingoscope.llm import token_alignment

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    return token_alignment.Tokenizers(A, B)


def plain(both, texts):
    """Each whole text by the libraries, then offsets, links and counts as they are defined."""
    rows, counts = [], Counter()
    for text in texts:
        found = ([], [], [], [])
        if text:
            a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            if both.whole(" " + text, a, b):
                spans = []
                for ids, data in ((a, both.bytes_a), (b, both.bytes_b)):
                    at, out = 0, []
                    for i in ids:
                        out.append((at, at := at + len(data[i])))
                    spans.append(out)
                ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                at = {e: k for k, e in enumerate(ends)}
                groups = [([], []) for _ in ends]
                for side, ids in enumerate((a, b)):
                    k = 0
                    for i, (_, e) in zip(ids, spans[side]):
                        groups[k][side].append(i)
                        k += e in at
                links, first = [], 0
                for i, (s, e) in zip(a, spans[0]):
                    while spans[1][first][1] <= s:
                        first += 1
                    links += [(i, b[k]) for k in range(first, len(b)) if spans[1][k][0] < e] if len(b) < 500 else [(i, b[k]) for k in range(first, min(len(b), first + 60)) if spans[1][k][0] < e]
                found = (a, b, groups, links)
        rows.append(found)
        counts.update(found[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join("|".join(",".join(map(str, ids)) for ids in x) for x in g).encode()).hexdigest() if a else "")
        for a, b, g, links in rows
    ]


def by_all(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_awkward_rows(spark, both):
    rows = awkward()
    texts = [r[1] for r in rows]
    want = [(r[0], *x) for r, x in zip(rows, plain(both, texts))]
    got = token_alignment.aligned(table(spark), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_all(got.collect()) == by_all(want)
    assert token_alignment.aligned(table(spark, []), A, B).count() == 0


def random_texts(rng, n):
    words = ["the", "thing", "é", "日本語", "ü", "ﬁ", "x", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "a▁b", "0", "12", "!", "''", "'s", "\x00", "😀", "𝔘", "naïve", "Привет", "ab" * 40]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "\xa0", "　", "", "\x1c", "\x85", "᠎", "​", " "]
    return ["".join(rng.choice(gaps) + rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice(gaps) for _ in range(n)]


@pytest.mark.parametrize("buckets, together", [(1, 50), (7, 1 << 20), (64, 300)])
def test_random_texts_in_small_groups(spark, both, monkeypatch, buckets, together):
    monkeypatch.setattr(token_alignment, "MEMO_BYTES", 1000)
    texts = random_texts(random.Random(buckets), 300)
    want = [(i, *x) for i, x in enumerate(plain(both, texts))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert by_all(token_alignment.aligned(rows, A, B, buckets=buckets, together=together).collect()) == by_all(want)


def test_chunks_as_whole_texts_for_every_character(both):
    aligner = token_alignment.Aligner(both)
    texts = [f"a{c}b {c} 1{c}\n{c}{c} \t{c}" for c in map(chr, [*range(0x300), *range(0x1680, 0x1690), *range(0x180B, 0x1810), *range(0x2000, 0x2070), *range(0x3000, 0x3008), 0xFEFF, 0x10000])]
    for start in range(0, len(texts), 1000):
        some = texts[start : start + 1000]
        sizes, hashes, _, _ = aligner.block(some)
        want = plain(both, some)
        assert [(*map(int, s), h) for s, h in zip(sizes, hashes)] == [(*w[:4], w[6]) for w in want]
