import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from cases import SCHEMA, awkward, table
from pyspark.sql import functions as F

from lingoscope.llm import column_bwt, exact_dedup, jaccard_join, language_id, mixing, packing, sharding, shingles, suffix_dedup, tokens, topk_search, toxicity
from lingoscope.llm.queries import tokenizer_path


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_all(rows):
    return sorted(map(repr, map(tuple, rows)))


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = []
    for r in rows:
        ids = [i for i in groups[lower(r[1])] if i is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want.append((r[0], best, len(groups[lower(r[1])]), True if best is None else None if r[0] is None else r[0] == best, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    got = exact_dedup.exact_groups(table(spark), keep=keep).collect()
    fix = lambda rows: by_all((*x[:3], bool(x[3]), x[4]) for x in rows)
    assert fix(got) == fix(want)


def test_texts_whose_hash_collides_stay_apart(spark):
    same = lambda text: F.lit("00")
    got = exact_dedup.exact_groups(table(spark), hash_of=same).select("doc_id", "keep_id", "group_size")
    assert by_all(got.collect()) == by_all(exact_dedup.exact_groups(table(spark)).select("doc_id", "keep_id", "group_size").collect())


def test_one_row_of_each_text_is_kept(spark):
    kept = exact_dedup.drop_exact_copies(table(spark)).collect()
    assert sorted(lower(r["text"]) for r in kept) == sorted({lower(r[1]) for r in awkward()})
    assert exact_dedup.drop_exact_copies(table(spark, [])).count() == 0


# ---------------------------------------------------------------- sharding and mixing


def test_shards(spark):
    rows = [(i, "t" * (i % 7), None, "big" if i % 3 else f"s{i % 5}", None, None, None, None, None) for i in range(3001)]
    out = sharding.stratified_shards(table(spark, rows), 8).collect()
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
        for source, n in Counter(r["source"] for r in out).items():
            assert abs(sum(r["shard"] == s and r["source"] == source for r in out) - n / 8) <= 2
    by_id = {r[0]: r for r in rows}
    assert all(r["size"] == len(by_id[r["doc_id"]][1]) + 1 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]][1].encode()) for r in out)


def test_shards_of_awkward_rows(spark):
    out = sharding.stratified_shards(table(spark), 8).collect()
    assert len(out) == len(awkward())
    assert all(r["size"] == len((r["doc_id"] is not None and awkward()[r["doc_id"]][1] or "").encode()) + 1 for r in out if r["doc_id"] is not None)
    assert sharding.stratified_shards(table(spark, []), 8).count() == 0
    few = sharding.stratified_shards(table(spark, awkward()[:3]), 8).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0]


def test_pfair_never_deviates_by_a_block():
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6), "d": Fraction(0)}
    plan = mixing.pfair({"a": 30, "b": 20, "c": 10, "d": 4}, weights)
    assert [p[0] for p in plan] == list(range(64)) and Counter(p[1] for p in plan) == {"a": 30, "b": 20, "c": 10, "d": 4}
    done = Counter()
    for slot, source, block, release, due, in_mix in plan:
        assert block == done[source]
        done[source] += 1
        if in_mix:
            assert release <= slot < due
            assert all(abs(done[s] - float(w) * (slot + 1)) < 1 for s, w in weights.items())
    assert [p[1] for p in plan[60:]] == ["d"] * 4


def test_mixing_keeps_all_rows_in_one_order(spark):
    rows = [(i, "t", None, "big" if i % 2 else f"s{i % 3}", None, "c", None, None, None) for i in range(1000)]
    out = mixing.mixed(table(spark, rows), weights={"big": 0.5, "s0": 0.25, "s1": 0.15, "s2": 0.1}, block_rows=10).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in out] == list(range(1000)) and sorted(r["doc_id"] for r in out) == list(range(1000))
    seen = Counter()
    for k, r in enumerate(out):
        if not r["in_mix"]:
            break
        seen[r["source"]] += 1
        assert abs(seen["big"] - 0.5 * (k + 1)) <= 2 * 10
    awk = mixing.mixed(table(spark)).collect()
    assert len(awk) == len(awkward()) and sorted(r["mix_position"] for r in awk) == list(range(len(awk)))
    assert mixing.mixed(table(spark, [])).count() == 0


# ---------------------------------------------------------------- tokens and packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_every_character_below_the_limit_tokenises_as_in_the_library():
    own, lib = tokens.Bpe(tokenizer_path()), library()
    texts = [f"a{c}b {c} 1{c}2 {c}{c} A{c}B ab{c} {c}'s <|{c} x<|endoftext|>{c}" for c in map(chr, range(0x250))]
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, monkeypatch):
    lib = library()
    out = tokens.token_counts(table(spark), tokenizer_path(), limit=5).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 5) for r in awkward()]
    assert by_all(out) == by_all(want)
    assert tokens.token_counts(table(spark, []), tokenizer_path()).count() == 0
    monkeypatch.setattr(tokens, "MEMO", 10)  # a memo that is too small changes nothing
    small = tokens.Bpe(tokenizer_path())
    texts = [r[1] or "" for r in awkward()] * 2
    assert small.counts(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def plain_best_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, b in enumerate(bins) if window - sum(b) >= n]
        best = min(fits, key=lambda k: window - sum(bins[k]), default=None)
        if best is None:
            bins.append([n])
        else:
            bins[best].append(n)
    return sorted(map(sum, bins))  # windows filled alike are interchangeable, so how full they are is what best fit decides


def test_packing_by_histogram_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(5, 60))
        lengths = rng.integers(1, window + 1, int(rng.integers(1, 120))).tolist()
        runs, windows = packing.best_fit_decreasing(dict(Counter(lengths)), window)
        filled = defaultdict(list)
        counts = Counter(lengths)
        for n in counts:
            own = sorted(r for r in runs if r[0] == n)
            for rank in range(counts[n]):
                run = [r for r in own if r[1] <= rank][-1]
                k = rank - run[1]
                filled[run[3] + k // run[2]].append((run[4] + k % run[2] * n, n))
        assert sorted(filled) == list(range(windows))
        for pieces in filled.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= window
        assert sorted(sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, window)


def test_packed_pieces_hold_every_id_once(spark):
    lib, window = library(), 128
    out = packing.packed(table(spark), tokenizer_path(), window).collect()
    of = defaultdict(list)
    for r in awkward():
        of[r[0]].append(lib.encode(r[1] or "", add_special_tokens=False).ids + [2])
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    for doc, texts in of.items():
        pieces = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc])
        assert pieces == Counter((s, len(t[s : s + window]), zlib.crc32(np.array(t[s : s + window], "<u4")), len(t)) for t in texts for s in range(0, len(t), window))
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    assert packing.packed(table(spark, []), tokenizer_path()).count() == 0


# ---------------------------------------------------------------- search


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, rng.uniform(0.05, 1), 16)], 0) for i in range(1500)]
    rows += [(2000, None, 0), (2001, [None] * 16, 0), (2002, [float("nan")] * 16, 0), (2100, rows[100][1], 0), (2101, [0.0] * 16, 0), (None, rows[0][1], 0), (2200, [0.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("id") % 100 == 0, k=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.floor(1024 * np.array(np.array(v, np.float32), float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and not any(map(math.isnan, v))]
    ids, matrix = np.array([u[0] for u in usable]), np.stack([u[1] for u in usable])
    for q, v in usable:
        if q % 100 == 0:
            scores = matrix @ v
            order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:10]
            assert sorted(got.pop(q)) == [(n + 1, ids[k], scores[k]) for n, k in enumerate(order)]
    assert not got
    assert topk_search.top_k(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_vectors_of_another_dimension_take_no_part(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(5)] + [(7, [9.0] * 3, 0), (100, [9.0], 0)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("id") % 100 == 0, k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2)]


# ---------------------------------------------------------------- near duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies():
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 160)))]
        for _ in range(12):
            own = list(words)
            for k in rng.integers(0, len(own), int(rng.integers(0, 9))):
                own[k] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    return texts + ["", None, "a b", "A  b", "c"]


@pytest.mark.parametrize("crowd", [128, 1])
def test_near_duplicates_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "MOST_PARTS", crowd)
    monkeypatch.setattr(jaccard_join, "CELL", 700)
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 7)
    texts = near_copies()
    rows = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_near_duplicates_of_awkward_rows(spark):
    got = jaccard_join.near_duplicates(table(spark)).collect()
    assert len(got) == len(awkward())
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert jaccard_join.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [128, 1])
def test_rows_without_an_id_bridge_near_duplicates(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "MOST_PARTS", crowd)
    words = [f"w{i}" for i in range(120)]
    chain = [" ".join([*(f"x{j}" for j in range(10 * k)), *words[10 * k :]]) for k in range(4)]  # neighbours are linked, others are not
    ids = [1, None, None, 2]
    rows = [(i, t, *[None] * 7) for i, t in zip([*ids, None, None, 7], [*chain, chain[1], "one two three four five", "six seven eight nine ten"])]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()]
    part = components([r[1] for r in rows])
    assert len({c for _, c in part}) == 3
    lowest = {c: min((r[0] for r, (_, d) in zip(rows, part) if c == d and r[0] is not None), default=None) for _, c in part}
    assert by_all(got) == by_all((r[0], n, lowest[c]) for r, (n, c) in zip(rows, part))


def test_sets_that_a_folding_confuses_stay_apart(spark, monkeypatch):
    """Where 64 bits are not enough to tell digests apart, another folding is taken."""
    plain = jaccard_join.folded
    monkeypatch.setattr(jaccard_join, "folded", lambda a, b, folding: plain(a, b, folding) % 5 if folding < 2 else plain(a, b, folding))
    texts = near_copies()
    rows = [(i, t, *[None] * 7) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_shingle_hashes_agree_with_sets():
    import pyarrow as pa

    texts = near_copies()
    sets = shingles.shingle_sets(pa.array(texts))
    for a, x in zip(texts[:20], sets):
        for b, y in zip(texts[:20], sets):
            assert len(np.intersect1d(x, y)) == len(shingle_set(a) & shingle_set(b))


# ---------------------------------------------------------------- repeated substrings


def cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("most", [4000, 2])
def test_repeated_substrings_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most)
    rng = np.random.default_rng(2)
    passage = "".join(map(chr, rng.integers(97, 123, 260)))
    prose = lambda n: "".join(map(chr, rng.integers(97, 110, n)))
    texts = [prose(300) + passage + prose(100), passage, prose(50) + passage[:230] + prose(400), "ab" * 200, "ab" * 150 + "c", None, "", prose(199), "é" * 300, prose(600)] + [prose(int(k)) + passage + prose(int(k)) for k in rng.integers(0, 80, 12)]
    texts.append(texts[-1])
    rows = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[1:5]) + (bytes(r["kept"]),) for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts, 200)


@pytest.mark.parametrize("common", [1000, 1])
def test_no_task_holds_a_crowded_anchor(spark, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", 5)
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    held, plain = [], suffix_dedup.marks

    def seen(pieces, length):
        held.append(max((r["count"] for r in pieces.groupBy("anchor").count().collect()), default=0))
        return plain(pieces, length)

    monkeypatch.setattr(suffix_dedup, "marks", seen)
    rng = np.random.default_rng(6)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, other = prose(320), prose(230)
    texts = [prose(int(k)) + passage + prose(int(k)) for k in rng.integers(20, 150, 30)] + [prose(60) + other, other + prose(60), prose(500), texts_twice := prose(300), texts_twice]
    rows = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[1:5]) + (bytes(r["kept"]),) for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts, 200)
    assert held and max(held) <= 5


def test_repeated_substrings_of_awkward_rows(spark):
    got = suffix_dedup.without_repeats(table(spark)).collect()
    want = cut([r[1] for r in awkward()], 200)
    assert by_all((r["doc_id"], *r[1:5]) for r in got) == by_all((r[0], *w[:4]) for r, w in zip(awkward(), want))
    assert suffix_dedup.without_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("most", [4000, 1])
def test_repeats_among_rows_without_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most)
    rng = np.random.default_rng(12)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, copy = prose(300), prose(400)
    texts = [prose(50) + passage + prose(70), prose(90) + passage, copy, copy, copy, prose(500), prose(300)]
    got = suffix_dedup.without_repeats(table(spark, [(None if i < 6 else i, t, *[None] * 7) for i, t in enumerate(texts)])).collect()
    assert by_all((*r[1:5], bytes(r["kept"])) for r in got) == by_all(cut(texts, 200))


@pytest.mark.parametrize("word", [1, 3, 8, 40])
def test_column_wise_construction_sorts_suffixes(word):
    rng = np.random.default_rng(word)
    for _ in range(40):
        strings = [bytes(rng.integers(97, 99, int(rng.integers(1, 60 * min(word, 4)))).astype(np.uint8)) for _ in range(int(rng.integers(1, 7)))]
        lengths = np.array(list(map(len, strings)))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(strings), np.uint8)
        if lengths.max() // word > 250:
            continue
        place, common = column_bwt.sorted_suffixes(data, starts, lengths, word)
        of = np.searchsorted(starts, place, "right") - 1
        suffixes = [data[p : p + (starts[o] + lengths[o] - p) // word * word].tobytes() for p, o in zip(place, of)]
        assert suffixes == sorted(suffixes) and len(suffixes) == int(np.maximum(0, lengths - word + 1).sum())
        for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
            k = 0
            while (k + 1) * word <= min(len(a), len(b)) and a[k * word : (k + 1) * word] == b[k * word : (k + 1) * word]:
                k += 1
            assert k == n


# ---------------------------------------------------------------- models


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language_id.fit_languages(docs, 1000)
    out = language_id.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.9
    awk = language_id.identify(table(spark), network).collect()
    assert len(awk) == len(awkward()) and all(0 <= r["score"] <= 1 for r in awk)
    und = {i for i, r in enumerate(awkward()[:20]) if not any(c.isalpha() for c in r[1] or "")}
    assert {r["doc_id"] for r in awk if r["lang_pred"] == "und" and r["doc_id"] is not None} == und
    assert language_id.fit_languages(table(spark, [])) is None
    assert language_id.identify(table(spark), None).where("lang_pred <> 'und'").count() == 0


def test_the_network_runs_as_it_was_trained():
    rng = np.random.default_rng(0)
    network = language_id.ByteConvolution(["a", "b"])
    x = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    pooled, _ = network._pooled(x)
    hidden = np.maximum(pooled.transpose(1, 0, 2).reshape(20, -1) + network.bias, 0)
    assert np.allclose(network.predict(x, network.joined()), language_id._softmax(hidden @ network.out + network.out_bias), atol=1e-5)


def model():
    text = "the idiot and the moron were stupid clowns pathetic worthless losers near the old house " * 200
    log4 = toxicity.log_model(toxicity.gram_counts(np.frombuffer(text.encode(), np.uint8)))
    return toxicity.Model(log4, {"idiot": 9.0, "moron": 9.0, "stupid": 9.0, "worthless": 9.0}, -4.0)


@pytest.mark.parametrize("written", ["idiot", "1d10t", "i d i o t", "idiooooot", "m0r0n", "s.t.u.p.i.d", "w0rthl3ss", "i_d_i_o_t", "M-O-R-O-N", "$tup1d", "stuuupid"])
def test_obfuscated_words_are_restored(written):
    (z, hits), = toxicity.Reader(model()).logits([f"you are {written} today"])
    assert z > 0 and hits == 1


@pytest.mark.parametrize("written, words", [("you i d i o t!", {"idiot"}), ("what a s t u p i d man", {"stupid"}), ("he is a m o r o n.", {"moron"}), ("so s t u p i d i d i o t today", {"stupid", "idiot"}), ("i. d. i. o. t.", {"idiot"}), ('"i d i o t" he', {"idiot"}), ("s t u u u p i d", {"stupid"}), ("the o l d house", {"old"})])
def test_words_set_apart_are_read_with_marks_and_neighbours(written, words):
    m = model()
    m.weights["old"] = 9.0
    (found,) = toxicity.Reader(m).hits([written])
    assert set(found) - {"stupi*"} == words


def test_clean_words_stay_clean():
    reader = toxicity.Reader(model())
    assert all(h == 0 for _, h in reader.logits(["the house, near 100 trees", "a b", "", "e=mc2 (1999)", "hash 3f2a9c"]))


def best_reading(span, log4):
    """All readings of a span, by brute force."""
    import itertools

    best = None
    for choice in itertools.product(*toxicity.lattice(span)):
        text, s, k = "".join(x for x, _ in choice), -sum(c for _, c in choice), 0
        for x in text + "`":
            code = k * 27 + ord(x) - 96
            s += float(log4[code])
            k = code % 19683
        if best is None or s > best[0] + 1e-9:
            best = (s, text)
    return best


def test_viterbi_finds_the_best_reading():
    log4 = model().log4
    for span in ("1d10t", "m0r0n!", "5tup1d", "l0o0ser", "p@th3t1c", "!d|ot", "a", "11"):
        assert toxicity.decode(span, log4) == best_reading(span, log4)[1], span


def test_toxicity_end_to_end(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, fitted)
    out = scored.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.6 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) <= 0.02
    awk = toxicity.score(table(spark), fitted).collect()
    assert len(awk) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in awk)
    clean = toxicity.without_toxic(docs, fitted)
    assert clean.columns == docs.columns and clean.count() == scored.where("predicted = 0").count()
    none = toxicity.fit(table(spark), labels.where("false"))
    assert toxicity.score(table(spark), none).where("score > 0").count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        if name == "mixing":
            assert docs.count() == before
        before = docs.count()
    tokens_out = docs.agg(F.sum("length")).first()[0]
    assert tokens_out == docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_windows_keep_the_mixture(spark, tmp_path, monkeypatch):
    """What the mixing stage decides holds in the final sequences: every prefix of them has the target weights."""
    import corpus_pipeline

    group = 256
    monkeypatch.setattr(packing.packed_in_order, "__defaults__", (*packing.packed_in_order.__defaults__[:-1], group))
    rng = np.random.default_rng(5)
    source = [["a", "b", "c"][k] for k in rng.choice(3, 6000, p=[0.6, 0.3, 0.1])]
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 40))), None, s, *[None] * 5) for i, s in enumerate(source)]
    mixing_stage, packing_stage = (stage for name, stage in corpus_pipeline.STAGES if name in ("mixing", "packing"))
    mixing_stage(spark, table(spark, rows), "").write.parquet(path := str(tmp_path / "mixed"))
    out = packing_stage(spark, spark.read.parquet(path), "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(6000))
    placed = Counter((r["sequence_id"]) for r in out)
    assert sorted(placed) == list(range(len(placed)))
    counts = Counter(source)
    weights = mixing.units_of({s: n**0.7 for s, n in counts.items()})
    weights = {s: u / sum(weights.values()) for s, u in weights.items()}
    horizon = min(counts[s] / w for s, w in weights.items())
    seen = Counter()
    for k, r in enumerate(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), 1):
        seen[source[r["doc_id"]]] += 1
        if k > horizon - group:
            break
        assert all(abs(seen[s] - w * k) <= group + 2 * mixing.BLOCK_ROWS for s, w in weights.items())
    assert k > 2000


def test_periods_give_the_same_schedule_as_one_run():
    """Pfair by phases and periods against earliest deadline first, slot by slot."""
    import heapq

    rng = np.random.default_rng(9)
    for _ in range(30):
        names = "abcde"[: int(rng.integers(1, 6))]
        blocks = {s: int(rng.integers(1, 90)) for s in names}
        units = {s: int(rng.integers(1, 9)) for s in names}
        plan = mixing.pfair(blocks, {s: Fraction(u, sum(units.values())) for s, u in units.items()})
        assert [p[0] for p in plan] == list(range(sum(blocks.values()))) and Counter(p[1] for p in plan) == blocks
        slot, done, live = 0, dict.fromkeys(names, 0), dict(units)
        want = []
        while live:
            total, start, base, ready, ended = sum(live.values()), slot, dict(done), [], None
            while ended is None:
                jobs = [(start - (-(done[s] - base[s] + 1) * total // u), s) for s, u in live.items() if start + (done[s] - base[s]) * total // u <= slot]
                _, s = min(jobs)
                want.append((slot, s, done[s]))
                done[s] += 1
                slot += 1
                ended = s if done[s] == blocks[s] else None
            del live[ended]
        assert [p[:3] for p in plan] == want


def test_mixing_positions_with_many_uneven_sources(spark):
    sizes = {"a": 700, "b": 131, "c": 64, "d": 1, None: 65, "z": 200}
    rows = [(i, "t", None, s, *[None] * 5) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mixed(table(spark, rows), weights={"a": 3, "b": 2, "c": 1, "d": 1, None: 1}).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in out] == list(range(len(rows)))
    assert [r["mix_slot"] for r in out] == sorted(r["mix_slot"] for r in out)
    assert {r["source"] for r in out[-200:]} == {"z"}  # no weight was stated for it
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)


def test_long_runs_of_letters_take_near_linear_time():
    import time

    own, lib = tokens.Bpe(tokenizer_path()), library()
    rng = np.random.default_rng(1)
    for n in (200, 257, 3000, 1_000_000):
        run = "".join(map(chr, rng.integers(97, 123, n)))
        began = time.time()
        got = own.ids([run, f"a {run[:5000]}!{run[:300]} b"])
        assert time.time() - began < 5 + n / 100_000
        assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch([run, f"a {run[:5000]}!{run[:300]} b"], add_special_tokens=False)]


def test_pieces_of_one_document_are_ranked_by_where_they_start(spark):
    """Ranks must not change when a task is run again, however its rows come."""
    rows = [(None if i % 2 else 7, "word " * 900, *[None] * 7) for i in range(20)] + [(7, f"w{i} " * 700, *[None] * 7) for i in range(20)]
    first = packing.packed(table(spark, rows), tokenizer_path(), 128)
    again = packing.packed(table(spark, rows[::-1]).repartition(3), tokenizer_path(), 128)
    assert by_all(first.collect()) == by_all(again.collect())
    shards = sharding.stratified_shards(table(spark, rows), 4)
    assert by_all(shards.collect()) == by_all(sharding.stratified_shards(table(spark, rows[::-1]).repartition(3), 4).collect())


def test_large_groups_of_copies_are_found_like_small_ones(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 3)
    rows = [(i, f"Text {i % 7}" if i % 3 else "SAME", *[None] * 7) for i in range(60)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(table(spark, rows), keep="largest").collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_any_column_names_pass_through(spark):
    names = ["doc_id", "text", "_text_sha256", "_kept_id", "sha", "held", "id", "kept_sha", "twins"]
    docs = spark.createDataFrame([(1, "one two three four five six", *"abcdefg"), (2, "ONE two three four five six", *"hijklmn"), (2, "ONE two three four five six", *"hijklmn"), (None, "x", *"opqrstu")], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names[2:])}")
    first = exact_dedup.drop_exact_copies(docs)
    assert first.columns == names and by_all(first.collect()) == by_all([(1, "one two three four five six", *"abcdefg"), (None, "x", *"opqrstu")])
    last = exact_dedup.drop_exact_copies(docs, keep="largest")
    assert by_all(last.collect()) == by_all([(2, "ONE two three four five six", *"hijklmn"), (None, "x", *"opqrstu")])
    near = jaccard_join.one_of_each(docs)
    assert near.columns == names and {r["doc_id"] for r in near.collect()} == {1, None}


def brute_top_k(rows, queries, k):
    """By integers of any size."""
    out = []
    for q in queries:
        scored = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["large", "normalised", "negative"])
def test_top_k_is_exact_in_every_cell(spark, monkeypatch, kind):
    """Scores beyond 2^53, vectors of one length, thresholds below 0; many small cells and blocks."""
    for name, n in (("CANDIDATE_BLOCK", 40), ("QUERY_BLOCK", 3), ("HEAD", 16), ("BUCKET_ROWS", 8), ("PRODUCTS", 2)):
        monkeypatch.setattr(topk_search, name, n)
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (300, 6))
    if kind == "large":
        m = np.round(m * 2.0**14) + 2.0**16
    elif kind == "normalised":
        m /= np.linalg.norm(m, axis=1)[:, None]
    else:
        m = np.abs(m) * np.where(np.arange(300) % 50 == 0, -1, 1)[:, None]
    rows = {i: [float(np.float32(x)) for x in v] for i, v in enumerate(m)}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("id") % 50 == 0, k=7).collect()))
    assert got == brute_top_k(rows, range(0, 300, 50), 7)
    if kind == "large":
        assert max(s for *_, s in got) > 2**53


def test_cells_out_of_reach_are_not_sent(spark, monkeypatch):
    blocks, cells = topk_search.meetings([0.0, 2.0, 2.0, 9.5], [1.0, 2.0, 3.0, 9.0])
    assert blocks == [(0, 0, 4), (1, 1, 4), (2, 1, 4), (3, 4, 4)] and cells == [(0, 0, 1), (1, 0, 3), (2, 0, 3), (3, 0, 3)]
    assert {(b, c) for b, low, high in blocks for c in range(low, high)} == {(b, c) for c, low, high in cells for b in range(low, high)}
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk_search, "HEAD", 30)
    rng = np.random.default_rng(3)
    rows = {i: (rng.uniform(0.9, 1, 4) * (1000.0 if i < 40 else 0.01)).tolist() for i in range(1000)}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, topk_search.top_k(df, F.col("id") % 100 == 0, k=5).collect())) == brute_top_k(rows, range(0, 1000, 100), 5)


def test_empty_vectors_and_scores_that_do_not_fit(spark):
    kind = "vec_id long, embedding array<double>, label int"
    got = topk_search.top_k(spark.createDataFrame([(0, [], 0), (1, [], 0), (2, [1.0], 0)], kind), F.col("id") == 0, k=2).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0)]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [1e9], 0), (1, [1e9], 0)], kind), F.col("id") == 0).collect()


@pytest.mark.parametrize("most", [2000, 2])
def test_the_construction_decides_what_repeats(spark, monkeypatch, most):
    """With a construction that only reads weights the result is wrong, in the plain and in the crowded path."""
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most)
    rng = np.random.default_rng(15)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = prose(300)
    texts = [prose(int(k)) + passage + prose(int(k)) for k in rng.integers(20, 150, 9)]
    rows = [(i, t, *[None] * 7) for i, t in enumerate(texts)]
    result = lambda: {r["doc_id"]: tuple(r[1:5]) for r in suffix_dedup.without_repeats(table(spark, rows).repartition(3), texts=False).collect()}
    want = [x[:4] for x in cut(texts, 200)]
    got = result()
    assert [got[i] for i in range(len(texts))] == want

    def by_weight(pieces, weights, windows, length):
        return [np.full(n, w > 1) for n, w in zip(windows, weights)]

    monkeypatch.setattr(suffix_dedup, "marked_windows", by_weight)
    got = result()
    assert [got[i] for i in range(len(texts))] != want


@pytest.mark.parametrize("buffer", [7, 64, 1 << 18])
def test_columns_may_exceed_their_buffer(monkeypatch, buffer):
    monkeypatch.setattr(column_bwt, "BUFFER", buffer)
    rng = np.random.default_rng(buffer)
    for word in (1, 4, 5, 12):
        strings = [bytes(rng.integers(97, 99, int(rng.integers(1, 120))).astype(np.uint8)) for _ in range(6)]
        lengths = np.array(list(map(len, strings)))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(strings), np.uint8)
        place, common = column_bwt.sorted_suffixes(data, starts, lengths, word)
        of = np.searchsorted(starts, place, "right") - 1
        suffixes = [data[p : p + (starts[o] + lengths[o] - p) // word * word].tobytes() for p, o in zip(place, of)]
        assert suffixes == sorted(suffixes) and len(suffixes) == int(np.maximum(0, lengths - word + 1).sum())
        for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
            same = [a[k : k + word] == b[k : k + word] and len(a) >= k + word for k in range(0, len(b), word)]
            assert n == (same.index(False) if False in same else len(same))


def test_shards_against_brute_force(spark):
    """The interleaved order itself: fractional ranks of a seeded shuffle, cut in equal parts."""
    rows = [(i, "t" * (i % 9), None, None if i % 17 == 0 else f"s{i % 3}" if i % 5 else "big", *[None] * 5) for i in range(900)]
    docs = table(spark, rows)
    size = F.length("text").cast("long") + 1
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.crc32(F.col("text").cast("binary")), size).alias("h")).collect()}
    by_source = defaultdict(list)
    for i, _, _, source, *_ in rows:
        by_source[source].append(i)
    place = {}
    for ids in by_source.values():
        for rank, i in enumerate(sorted(ids, key=lambda i: (hashed[i], i))):
            place[i] = (rank + 0.5) / len(ids)
    order = sorted(place, key=lambda i: (place[i], hashed[i]))
    want = {i: at * 8 // len(order) for at, i in enumerate(order)}
    first = {s: min(at for at in range(len(order)) if at * 8 // len(order) == s) for s in range(8)}
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.stratified_shards(docs, 8).collect()}
    assert got == {i: (want[i], at - first[want[i]]) for at, i in enumerate(order)}


def test_mixed_rows_follow_the_schedule(spark):
    """Slots of rows, found by periods in tasks, against the schedule slot by slot."""
    rng = np.random.default_rng(2)
    source = [["a", "b", "c", None][k] for k in rng.choice(4, 2500, p=[0.55, 0.25, 0.15, 0.05])]
    rows = [(i, "t", None, s, *[None] * 5) for i, s in enumerate(source)]
    out = mixing.mixed(table(spark, rows), temperature=0.5, block_rows=7).collect()
    counts = Counter(source)
    units = mixing.units_of({s: n**0.5 for s, n in counts.items()})
    plan = mixing.pfair({s: -(-n // 7) for s, n in counts.items()}, {s: Fraction(u, sum(units.values())) for s, u in units.items()})
    assert {(r["mix_slot"], r["source"], r["mix_block"], r["mix_release"], r["mix_deadline"], r["in_mix"]) for r in out} == set(plan)
    start = np.cumsum([0, *(min(7, counts[s] - 7 * b) for _, s, b, *_ in plan)])
    assert sorted(r["mix_position"] for r in out) == list(range(2500))
    assert all(start[r["mix_slot"]] <= r["mix_position"] < start[r["mix_slot"] + 1] for r in out)


def test_toxicity_of_rows_that_were_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id")
    n = Counter((r["toxic"], r["predicted"]) for r in scored.collect())
    assert n[1, 1] >= 0.5 * (n[1, 1] + n[1, 0]) > 0 and n[0, 1] <= 0.05 * (n[0, 0] + n[0, 1])


def test_mixing_of_many_sources_keeps_their_weights(spark):
    """One source at one half, 5,000 that share the rest: less than a block of deviation at every prefix."""
    rows = [(i, "t", None, "big", *[None] * 5) for i in range(20000)] + [(20000 + i, "t", None, f"s{i % 5000}", *[None] * 5) for i in range(20000)]
    weights = {"big": 0.5} | {f"s{i}": 0.5 / 5000 for i in range(5000)}
    units = mixing.units_of(weights)
    assert units["big"] * 2 == sum(units.values())
    out = mixing.mixed(table(spark, rows), weights=weights, block_rows=1).select("doc_id", "source", "mix_slot", "mix_position", "mix_release", "mix_deadline", "in_mix").collect()
    out.sort(key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in out] == list(range(40000)) and len({r["doc_id"] for r in out}) == 40000
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    seen, mixed_rows = Counter(), 0
    for k, r in enumerate(out):
        if not r["in_mix"]:
            break
        mixed_rows += 1
        seen[r["source"]] += 1
        assert abs(seen["big"] - 0.5 * (k + 1)) < 1 and seen[r["source"]] - weights[r["source"]] * (k + 1) < 1
    assert mixed_rows > 20000


def test_mixing_of_many_sources_with_ends_and_without_weights(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "t", None, None if s == 0 else f"s{s}", *[None] * 5) for i, s in enumerate(rng.zipf(1.3, 4000) % 60)]
    counts = Counter(r[3] for r in rows)
    weights = {s: n for k, (s, n) in enumerate(counts.items()) if k % 9}
    out = mixing.mixed(table(spark, rows), weights=weights, block_rows=3).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in out] == list(range(4000)) and {r["doc_id"] for r in out} == set(range(4000))
    assert [r["mix_slot"] for r in out] == sorted(r["mix_slot"] for r in out)
    assert [r["source"] in weights for r in out] == [True] * sum(weights.values()) + [False] * (4000 - sum(weights.values()))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    assert Counter((r["source"], r["mix_block"]) for r in out) == {(s, b): min(3, n - 3 * b) for s, n in counts.items() for b in range(-(-n // 3))}


def test_one_of_each_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join([*words[:59], "other"])
    apart, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    more = (None, None, None)
    rows = [(1, base, *more), (None, near, *more), (None, apart, *more), (7, near, *more), (7, third, *more), (None, third + " z", *more), (9, "", *more), (9, "", *more), (None, None, *more), (4, apart + " q", "b", *more[1:]), (4, apart + " q", "a", *more[1:])]
    rows = [(*r, "clash", 1, 2, 3) for r in rows]
    kept = jaccard_join.one_of_each(table(spark, rows), words=5, percent=75).collect()
    assert sorted((repr(r["doc_id"]), r["text"], r["lang"]) for r in kept) == sorted((repr(i), t, lang) for i, t, lang in [(1, base, None), (4, apart + " q", "a"), (7, third, None), (9, "", None), (9, "", None), (None, None, None)])


def test_of_rows_alike_in_id_and_text_the_least_stays(spark):
    rows = [(1, "Text", lang, None, None, "clash", 1, 2, 3) for lang in ("c", "b", "a", "d")] + [(2, "text", "z", None, None, "clash", 1, 2, 3)]
    kept = exact_dedup.drop_exact_copies(table(spark, rows), keep="smallest").collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(1, "a")]
