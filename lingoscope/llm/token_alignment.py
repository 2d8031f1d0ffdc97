"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Tokenizer A (a byte-level BPE file of the tokenizers library) encodes a space and the
text; tokenizer B (a sentencepiece model that puts a space first itself) the text.  Both
sequences of tokens cover the same bytes.  Offsets where tokens of both end cut them into
groups; an A token and a B token whose bytes overlap are linked.

Postings cogroup.  Each task encodes a block of documents and writes postings: of each
pair of ids the documents that link it and how many times, bucketed by the B id.  Counts
of pairs are summed, partial sums first.  Then each bucket's counts and postings meet:
a partition's stream is sorted (Spark spills), so that a bucket's counts come before its
postings; the task finds each B id's highest count, and each posting list gives its
documents' contributions, which are summed by document.  A bucket with more than
``TOGETHER`` postings is dealt out by blocks to several groups, to which its counts, at
most as many as pairs of ids exist, are repeated.

Texts are cut into chunks where no token of either can cross: before a blank (also a
line feed or a tab, if the model has no piece with it) that follows a character that is
no white space.  That the model's pieces allow it is checked when it is loaded.  Chunks
are encoded by the libraries, all that a block needs together, and kept in a memo.

Cases: texts that are null or empty, or whose tokens' bytes differ from space and text
(a model may map characters), have no tokens: zeros and an empty string for the hash.
Strings of special tokens are ordinary text.  Ids pass through, nulls and repetitions
included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.byte_bpe import WHITE, workers_own
from lingoscope.llm.common import narrow, sparing, text_lists
from lingoscope.operators.storage import stored

BLOCK = 4 << 20  # bytes of texts whose postings are written together
MEMO_BYTES = 96 << 20  # of keys, strings and pairs in the memo
BUCKETS = 64  # of B ids
TOGETHER = 1 << 23  # postings that meet their counts in one group
SHIFT = 20  # bits of an A id in a pair, and of a document's place in its block
#: Further characters that some engines take for white space; no cut stands beside them.
UNSURE = "\x1c-\x1f᠎​﻿"


def byte_characters() -> dict[str, int]:
    """The visible characters that byte-level vocabularies print bytes as."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in visible}
    return char | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut for both."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = byte_characters()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_a) > 1 << SHIFT or len(pieces) > 1 << 31 - 1:
            raise ValueError("too many ids")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        cuts = "".join(c for c in "\n\t" if not any(c in p for p in plain))
        if self.b.encode(" ", out_type=str) != ["▁▁"] or any(re.search(r"[^ ] ", p) for p in plain):
            self.chunks = re.compile(r"(?s).+").findall  # its pieces may cross blanks, so texts stay whole
        else:
            white = WHITE + UNSURE
            other = "".join(c for c in WHITE.replace(" ", "").replace("\n", "").replace("\t", "")) + UNSURE + "".join(c for c in "\n\t" if c not in cuts)
            self.chunks = re.compile(f"[{white}]*[^{white}]+(?:[{other}][{white}]*[^{white}]*)*|[{white}]+").findall
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.decimal = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks, of a text that begins with the added space."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for c, ids in zip(chunks, b):
            if c[0] != " ":  # the space that the model puts first stands alone before a character that no piece has
                assert ids.pop(0) == self.space
        return a, b

    def whole(self, chunk: str, a: list[int], b: list[int]) -> bool:
        data = chunk.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))


class Aligner:
    """Groups and links of chunks, kept by number."""

    def __init__(self, tokenizers: Tokenizers, memo_bytes: int = MEMO_BYTES):
        self.t, self.memo_bytes = tokenizers, memo_bytes
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: bytes differ
        self.sizes = array("i")  # n_a, n_b, n_groups, n_links of each
        self.pairs = array("q")  # one after another
        self.starts = array("q")
        self.held = 0

    def learn(self, chunks: list[str]) -> None:
        """Numbers chunks that are new."""
        t = self.t
        for start in range(0, len(chunks), 20_000):
            some = chunks[start : start + 20_000]
            ids_a, ids_b = t.encode(some)
            data = "".join(some).encode()
            if any(b"".join(map(of.__getitem__, chain.from_iterable(ids))) != data for of, ids in ((t.bytes_a, ids_a), (t.bytes_b, ids_b))):
                for k, fits in enumerate(t.whole(*x) for x in zip(some, ids_a, ids_b)):
                    if not fits:
                        self._keep([some[k]], [None], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))
                fits = [c not in self.number for c in some]
                some, ids_a, ids_b = ([y for y, fit in zip(x, fits) if fit] for x in (some, ids_a, ids_b))
            if some:
                self._keep(some, *self._aligned(ids_a, ids_b))

    def _keep(self, chunks: list[str], groups: list[str | None], sizes: np.ndarray, pairs: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.starts.frombytes((len(self.pairs) + np.cumsum(sizes[:, 3]) - sizes[:, 3]).tobytes())
        self.groups += groups
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        self.pairs.frombytes(pairs.tobytes())
        self.held += sum(map(len, chunks)) + sum(len(g or "") for g in groups) + 8 * len(pairs) + 200 * len(chunks)

    def _aligned(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each chunk its groups as text and its sizes; all linked pairs; the chunks lie one after another."""
        t = self.t
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        first = np.searchsorted(ends_b, ends_a - t.length_a[a], "right")  # of the B tokens that an A token meets
        last = np.searchsorted(ends_b, ends_a, "left")
        met = last - first + 1
        upto = np.concatenate([[0], np.cumsum(met)])
        links = np.repeat(first - upto[:-1], met) + np.arange(upto[-1])
        pairs = b[links] << SHIFT | np.repeat(a, met)
        closing = np.flatnonzero(ends_b[last] == ends_a)  # A tokens that end where a B token does
        in_a, in_b = closing + 1, last[closing] + 1
        of_a = np.cumsum(n_a)
        in_g = np.searchsorted(in_a, of_a, "right")
        sizes = np.stack([n_a, n_b, np.diff(in_g, prepend=0), np.diff(upto[of_a], prepend=0)], 1)
        decimal = t.decimal.__getitem__
        text_a, text_b = list(map(decimal, a.tolist())), list(map(decimal, b.tolist()))
        parts, i, j = [], 0, 0
        for p, q in zip(in_a.tolist(), in_b.tolist()):
            parts.append(f"{text_a[i]}|{text_b[j]}" if p - i == 1 == q - j else f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        groups, g = [], 0
        for h in in_g.tolist():
            groups.append(parts[g] if h - g == 1 else ";".join(parts[g:h]))
            g = h
        return groups, sizes, pairs

    def block(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Sizes and hashes of texts, and the links: pairs, and the text of each."""
        if self.held > self.memo_bytes:
            self.forget()
        lists = [self.t.chunks(" " + x) if x else [] for x in texts]
        self.learn(list({c for chunks in lists for c in chunks}.difference(self.number)))
        number, groups = self.number, self.groups
        entries = [list(map(number.__getitem__, chunks)) for chunks in lists]
        differ = {e for e in set(chain.from_iterable(entries)) if groups[e] is None}
        for k, x in enumerate(texts if differ else []):
            if not differ.isdisjoint(entries[k]):  # only the whole text can tell
                if (whole := " " + x) not in number:
                    self.learn([whole])
                entries[k] = [number[whole]] if groups[number[whole]] is not None else []
        hashes = [hashlib.sha256(";".join([groups[e] for e in es]).encode()).hexdigest() if es else "" for es in entries]
        many = np.fromiter(map(len, entries), np.int64, len(texts))
        every = np.fromiter(chain.from_iterable(entries), np.int64, many.sum())
        of = np.repeat(np.arange(len(texts)), many)
        each = np.frombuffer(self.sizes, np.int32).reshape(-1, 4)[every].astype(np.int64)
        sizes = np.zeros((len(texts), 4), np.int64)
        np.add.at(sizes, of, each)
        links = each[:, 3]
        at = np.repeat(np.frombuffer(self.starts, np.int64)[every] - np.cumsum(links) + links, links) + np.arange(links.sum())
        pairs = np.frombuffer(self.pairs, np.int64)[at]
        return sizes, hashes, pairs, np.repeat(of, links)


def postings(pairs: np.ndarray, texts: np.ndarray, buckets: int):
    """Of each bucket (bucket, pairs, counts, runs, docs, times): the texts of each pair, and how many times each links it."""
    order = np.sort(pairs << SHIFT | texts)
    cuts = np.flatnonzero(np.diff(order, prepend=-1))
    times = np.diff(cuts, append=len(order))
    pair, text = order[cuts] >> SHIFT, order[cuts] & (1 << SHIFT) - 1
    bucket = (pair >> SHIFT) * 2654435761 % (1 << 32) * buckets >> 32
    by = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in range(buckets):
        own = by[bounds[k] : bounds[k + 1]]
        if len(own):
            p = pair[own]
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            yield k, p[starts], np.add.reduceat(times[own], starts), np.diff(starts, append=len(own)), text[own], times[own]


POSTINGS = {"bucket": pa.int32(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "runs": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
SIZES = ["n_a", "n_b", "n_groups", "n_links"]
ENCODED = "id {kind}, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, pairs array<long>, counts array<long>, runs array<int>, docs array<int>, times array<int>"


def encoded(docs: DataFrame, path_a: str, path_b: str, buckets: int = BUCKETS) -> DataFrame:
    """Of rows (id, text): rows of documents (no bucket) and rows of postings.

    ``key`` numbers the documents of all tasks; a posting row has its block's first, to
    which the places in ``docs`` are added.
    """

    @sparing
    def encode(batches):
        aligner = workers_own(f"align {path_a} {path_b}", lambda: Aligner(Tokenizers(path_a, path_b)))
        first = TaskContext.get().partitionId() << 42
        for batch in batches:
            for start, some in text_lists(batch.column("text"), BLOCK):
                sizes, hashes, pairs, of = aligner.block(some)
                n, ids = len(some), batch.column("id").slice(start, len(some))
                heads = [ids, pa.array(first + np.arange(n)), *[pa.array(sizes[:, k]) for k in range(4)], pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(heads + [pa.nulls(n, t) for t in POSTINGS.values()], names=["id", "key", *SIZES, "groups_sha256", *POSTINGS])
                lists = [*postings(pairs, of, buckets)] if len(pairs) else []
                if lists:
                    held = [pa.array(x, t) for x, t in zip(zip(*lists), POSTINGS.values())]
                    no = [pa.nulls(len(lists), t) for t in (ids.type, *[pa.int64()] * 4, pa.string())]
                    yield pa.RecordBatch.from_arrays([no[0], pa.array([first] * len(lists), pa.int64()), *no[1:], *held], names=["id", "key", *SIZES, "groups_sha256", *POSTINGS])
                first += 1 << SHIFT

    return docs.mapInArrow(encode, ENCODED.format(kind=docs.schema["id"].dataType.simpleString()))


class Bucket:
    """Counts of one bucket's pairs, as they come in order, and what its postings contribute."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def close(self) -> None:
        self.pairs, self.counts = (np.concatenate(x) for x in zip(*self.parts))
        of_b = self.pairs >> SHIFT
        starts = np.flatnonzero(np.diff(of_b, prepend=-1))
        highest = np.maximum.reduceat(self.counts, starts)
        self.best = self.counts == np.repeat(highest, np.diff(starts, append=len(of_b)))

    def contributions(self, pairs, runs, docs, times) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of documents, their links of highest count, and their sums of counts."""
        at = np.searchsorted(self.pairs, pairs)
        n_best, count_sum = np.zeros((2, docs.max() + 1), np.int64)
        np.add.at(n_best, docs, times * np.repeat(self.best[at], runs))
        np.add.at(count_sum, docs, times * np.repeat(self.counts[at], runs))
        held = np.unique(docs)
        return held, n_best[held], count_sum[held]


def contributed(stream: DataFrame) -> DataFrame:
    """Of sorted rows (bucket, salt, counts before postings): key, n_best, count_sum of each posting list's documents."""

    def meet(batches):
        held, of = None, None
        for batch in batches:
            group = np.stack([np.asarray(batch.column(c)) for c in ("bucket", "salt")], 1)
            lead = np.asarray(batch.column("pair").is_valid())
            ends = [*(np.flatnonzero((group[1:] != group[:-1]).any(1) | (lead[1:] != lead[:-1])) + 1), batch.num_rows]
            start = 0
            for end in ends:
                if of != (of := tuple(group[start])) or held is None:
                    held = Bucket()
                if lead[start]:
                    held.parts.append(tuple(np.asarray(batch.column(c).slice(start, end - start)) for c in ("pair", "count")))
                else:
                    if held.parts:
                        held.close()
                        held.parts = []
                    for k in range(start, end):
                        lists = [np.asarray(batch.column(c)[k].values, np.int64) for c in ("pairs", "runs", "docs", "times")]
                        docs, n_best, count_sum = held.contributions(*lists)
                        yield pa.RecordBatch.from_arrays([pa.array(docs + batch.column("key")[k].as_py()), pa.array(n_best), pa.array(count_sum)], names=["key", "n_best", "count_sum"])
                start = end

    return stream.mapInArrow(meet, "key long, n_best long, count_sum long")


def aligned(docs: DataFrame, path_a: str, path_b: str, buckets: int = BUCKETS, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    both = stored(encoded(narrow(docs, id=id_col, text=text_col), path_a, path_b, buckets))
    lists = both.where("bucket is not null")
    # a row for each bucket: how many groups it is dealt to
    groups = lists.groupBy("bucket").agg(F.ceil(F.sum(F.size("docs")) / together).cast("int").alias("groups"))
    counts = lists.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"), "bucket").groupBy("bucket", F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    no = {c: F.lit(None).cast(lists.schema[c].dataType) for c in ("key", "pairs", "runs", "docs", "times")}
    heads = counts.join(F.broadcast(groups), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "pair", "count", *[v.alias(k) for k, v in no.items()])
    salt = F.pmod(F.xxhash64("key"), F.col("groups")).cast("int")
    tails = lists.join(F.broadcast(groups), "bucket").select("bucket", salt.alias("salt"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("count"), *no)
    stream = heads.union(tails).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("pair").asc_nulls_last())
    sums = contributed(stream).groupBy(F.col("key").alias("of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = both.where("bucket is null").select("id", "key", *SIZES, "groups_sha256")
    return rows.join(sums, F.col("key") == F.col("of"), "left").select(
        F.col("id").alias(id_col), *SIZES, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
