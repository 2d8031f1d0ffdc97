"""Removal of repeated substrings by suffix arrays built column by column.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere
else in the collection goes; overlaps count, matches never cross documents, and
strings are judged on the input.

No suffix array over the whole collection is needed to know which strings are
equal: equal strings have the same smallest hash among their 64-byte substrings.

1. Scan: for all windows of ``LENGTH`` bytes, the smallest of those hashes, their
   anchor.  Neighbouring windows with one anchor make a piece; a row says where
   it is, its anchor and a digest of its bytes.
2. Anchors that occur once in the corpus are dropped: their windows are unique.
   (A piece that repeats itself has its anchor in two places, and counts twice.)
   Equal pieces, by 128 bits of hashes, are folded to one with a weight.  A folded
   piece that is the only one of its anchor is repeated as it stands.
3. The texts of all other pieces, joined by their row's key, are brought together
   by anchor.  Each task builds the sorted suffixes and common prefixes of its
   pieces by the column-wise construction (see column_bwt), a block of anchors at
   a time; suffixes that share ``LENGTH`` bytes and weigh two or more are marked.
4. Marks go back to all places of their pieces, and by key to the texts, which are
   cut there.

An anchor with very many different pieces (the edges of a passage that a large
part of the corpus quotes) never comes to one task: its pieces are opened to
single windows.  Those whose hash occurs once are unique; of the others, two of
each hash from each batch are dealt out and compared by the same construction.
What most pieces share is looked up in a broadcast table, so no key gathers more
than ``COMMON`` rows, and a block's memory stays bounded whatever the anchor's
count.

Cases: null text counts as empty; texts below ``LENGTH`` bytes lose nothing; a
row's key is a digest of its id and text, so rows with null or repeated ids are
told apart (and what two keys might share, by the digests of the pieces); equal
rows repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.column_bwt import repeated_places
from lingoscope.llm.common import byte_sized, narrow, sparing, utf8_of
from lingoscope.llm.shingles import _power, mixed
from lingoscope.operators.storage import discard, stored

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 160_000  # of pieces that are sorted together
MOST_PIECES = 2_000  # different pieces of one anchor that are sorted as they are
COMMON = 1_000  # pieces with one window from which it is broadcast; there are at most (windows / COMMON) of those
PIECE = 1 << 18  # bytes of texts that a task looks at together

_CODE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    return total, inverse


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(text, start within it, windows, anchor, digest, places of the anchor) of all pieces, as arrays."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    total, inverse = _sums(data)
    grams = mixed((total[gram:] - total[:-gram]) * inverse[: len(total) - gram])
    anchor = sliding_min(grams, length - gram + 1)
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)[:n]
    valid = np.arange(n) + length <= bounds[1:][text]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(opens)
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    count = np.flatnonzero(closes) + 1 - start
    most = length - gram + 1  # only a text that repeats itself within a window exceeds it
    parts = -(-count // most)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(count, parts) - nth * most
        start, count = np.repeat(start, parts) + nth * most, np.minimum(left, most)
    end = start + count + length - 1
    digest = mixed((total[end] - total[start]) * inverse[start] + count.astype(np.uint64))
    of = text[start]
    return of, start - bounds[of], count, anchor[start], digest, _times(grams, anchor, start, count, length - gram + 1)


def _times(grams: np.ndarray, anchor: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """In how many places of each piece its anchor stands."""
    edge = np.zeros(width - 1, np.uint64)
    reach = ~sliding_min(~np.concatenate([edge, anchor, edge]), width)  # the largest anchor of the windows over a place
    places = np.flatnonzero(grams == reach)
    low, high = np.searchsorted(places, start), np.searchsorted(places, start + count + width - 1)
    held = high - low
    of = np.repeat(np.arange(len(start)), held)
    at = places[np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held) + low[of]]
    return np.bincount(of, grams[at] == anchor[start[of]], len(start)).astype(np.int64)


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    @sparing
    def run(batches):
        for batch in batches:
            for first, n in byte_sized(batch.column("text"), PIECE):
                data, bounds = utf8_of(batch.column("text").slice(first, n))
                of, start, count, anchor, digest, times = pieces_of(data, bounds, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(of + first)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(times.astype(np.int32))],
                    names=["key", "start", "windows", "anchor", "digest", "times"],
                )

    return docs.select("key", "text").mapInArrow(run, "key long, start int, windows int, anchor long, digest long, times int")


def piece_texts(folded: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, weight, windows, bytes, crowded) of each piece, cut from the text that has it."""
    lists = folded.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor", "digest", "weight", "crowded")).alias("pieces"))
    rows = lists.join(docs, "key").select("text", "pieces")

    @sparing
    def run(batches):
        for batch in batches:
            column, lists = batch.column("text"), batch.column("pieces")
            for i in range(len(batch)):
                raw = (column[i].as_py() or "").encode()
                total, inverse = _sums(np.frombuffer(raw, np.uint8))
                inner = lists.slice(i, 1).flatten()
                start, windows, anchor, digest, weight, crowded = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                end = start + windows + length - 1
                here = end <= len(raw)
                same = np.zeros(len(start), bool)
                a, b, w = start[here], end[here], windows[here]
                same[here] = mixed((total[b] - total[a]) * inverse[a] + w.astype(np.uint64)) == digest[here].view(np.uint64)
                k = np.flatnonzero(same)  # another text with the same key has other pieces there
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[k]), pa.array(digest[k]), pa.array(weight[k]), pa.array(windows[k]), pa.array([raw[start[j] : end[j]] for j in k], pa.binary()), pa.array(crowded[k])],
                    names=["anchor", "digest", "weight", "windows", "bytes", "crowded"],
                )

    return rows.mapInArrow(run, "anchor long, digest long, weight long, windows int, bytes binary, crowded boolean")


def marked_windows(pieces: list[bytes], weights: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows occur elsewhere."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(pieces), np.uint8)
    places = repeated_places(data, starts, lengths, weights, length)
    flat = np.zeros(len(data), bool)
    flat[places] = True
    return [flat[s : s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hashes of the ``length`` bytes from each place on, in two numbers."""
    total, inverse = _sums(data)
    plain = (total[length:] - total[:-length]) * inverse[: len(total) - length]
    power, back = _power(len(data) + 1)
    other = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[255 - data] * power[: len(data)], out=other[1:])
    return mixed(plain, 11).view(np.int64), mixed((other[length:] - other[:-length]) * back[: len(other) - length], 12).view(np.int64)


def opened(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, windows, weight, at, first, second) of every single window; the last two are its hash."""

    @sparing
    def run(batches):
        for batch in batches:
            for first, n in byte_sized(batch.column("bytes"), BLOCK_BYTES):
                some = batch.slice(first, n)
                data, bounds = utf8_of(some.column("bytes"))
                windows = some.column("windows").to_numpy()
                piece = np.repeat(np.arange(n), windows)
                at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
                hashes = window_hashes(data, length)
                of = pa.array(piece)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c).take(of) for c in ("anchor", "digest", "windows", "weight")), pa.array(at.astype(np.int32)), *(pa.array(h[bounds[piece] + at]) for h in hashes)],
                    names=["anchor", "digest", "windows", "weight", "at", "first", "second"],
                )

    return pieces.mapInArrow(run, "anchor long, digest long, windows int, weight long, at int, first long, second long")


def joined_by_hash(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose (first, second) is in ``held``, with its ``common``: whether very many rows have it."""
    key = ["first", "second"]
    common = rows.join(F.broadcast(held.where("common")), key, "left")
    # the others have at most COMMON rows each; no row of a common one takes part in that shuffle
    rare = common.where("common is null").drop("common").join(held.where("not common"), key)
    return common.where("common").select(rare.columns).unionByName(rare)


def windows_of(pieces: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(first, second, common, weight, window) of the windows at ``places``; of those with one hash two of a batch will do."""
    lists = places.groupBy("anchor", "digest").agg(F.collect_list(F.struct("at", "first", "second", "common")).alias("list"))
    rows = pieces.select("anchor", "digest", "weight", "bytes").join(lists, ["anchor", "digest"]).select("weight", "bytes", "list")

    @sparing
    def run(batches):
        for batch in batches:
            for start, n in byte_sized(batch.column("bytes"), BLOCK_BYTES):
                some = batch.slice(start, n)
                data, bounds = utf8_of(some.column("bytes"))
                lists = some.column("list")
                of = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                at, first, second, common = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
                weight = some.column("weight").to_numpy()[of]
                order = np.lexsort((second, first))
                opens = np.ones(len(order), bool)
                opens[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
                two = order[nth < 2]  # of equal ones; that they are equal is for the construction to find
                for k in range(0, len(two), part := max(1, PIECE // length)):
                    few = two[k : k + part]
                    held = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[bounds[of[few]] + at[few]])
                    offsets = np.arange(len(few) + 1, dtype=np.int32) * np.int32(length)
                    window = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first[few]), pa.array(second[few]), pa.array(common[few]), pa.array(weight[few]), window], names=["first", "second", "common", "weight", "window"]
                    )

    return rows.mapInArrow(run, "first long, second long, common boolean, weight long, window binary")


def confirmed(windows: DataFrame, length: int) -> DataFrame:
    """(first, second, common) of the windows that the construction finds twice or more."""
    dealt = windows.repartition("first").sortWithinPartitions("first", "second")

    @sparing
    def run(batches):
        def block(rows):
            found = marked_windows([r[4] for r in rows], np.array([r[3] for r in rows], np.int64), np.ones(len(rows), np.int64), length)
            names = sorted({r[:3] for r, m in zip(rows, found) if m[0]})
            return pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array([n[2] for n in names], pa.bool_())], names=["first", "second", "common"]
            )

        held = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if len(held) * length >= BLOCK_BYTES and row[:2] != held[-1][:2]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return dealt.mapInArrow(run, "first long, second long, common boolean")


def crowded_marks(pieces: DataFrame, length: int) -> DataFrame:
    """What ``marks`` gives, for the pieces of crowded anchors: window by window."""
    single = stored(opened(pieces, length))
    counts = single.groupBy("first", "second").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("pieces"))
    twice = stored(counts.where("n > 1").select("first", "second", (F.col("pieces") > COMMON).alias("common")))
    places = stored(joined_by_hash(single.drop("weight"), twice))
    equal = stored(confirmed(windows_of(pieces, places, length), length))
    found = joined_by_hash(places.drop("common"), equal)
    lists = found.groupBy("anchor", "digest", "windows").agg(F.collect_set("at").alias("at"))

    def pack(batches):
        for batch in batches:
            out = []
            for at, n in zip(batch.column("at"), batch.column("windows").to_pylist()):
                flat = np.zeros(n, bool)
                flat[at.values.to_numpy()] = True
                out.append(np.packbits(flat).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("digest"), pa.array(out, pa.binary())], names=["anchor", "digest", "marks"])

    return lists.mapInArrow(pack, "anchor long, digest long, marks binary")


def marks(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, marks): the windows of each piece that occur elsewhere, as packed bits.

    No anchor has more than ``MOST_PIECES`` pieces here.
    """
    sorted_ = pieces.repartition("anchor").sortWithinPartitions("anchor", "digest")

    @sparing
    def run(batches):
        def block(rows):
            texts = [r[4] for r in rows]
            weights, windows = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
            found = marked_windows(texts, weights, windows, length)
            some = [k for k, m in enumerate(found) if m.any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in some], pa.int64()), pa.array([rows[k][1] for k in some], pa.int64()), pa.array([np.packbits(found[k]).tobytes() for k in some], pa.binary())],
                names=["anchor", "digest", "marks"],
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield block(held)
                    held, size = [], 0
                if not held or row != held[-1]:  # equal rows of the table give a piece more than once
                    held.append(row)
                    size += len(row[4])
        if held:
            yield block(held)

    return sorted_.mapInArrow(run, "anchor long, digest long, marks binary")


def cut_texts(docs: DataFrame, places: DataFrame, length: int, texts: bool) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every text; ``kept`` is what remains, as bytes, if asked for."""
    # a set, as equal rows have one key and equal places: a list holds one text's places, however many rows bear it
    lists = places.groupBy("key").agg(F.collect_set(F.struct("start", "windows", "digest", "marks")).alias("places"))
    rows = docs.join(lists, "key", "left").select("id", "text", "places")

    @sparing
    def run(batches):
        for batch in batches:
            column, lists = batch.column("text"), batch.column("places")
            for first, n in byte_sized(column, PIECE):
                out = ([], [], [], [], [])
                for i in range(first, first + n):
                    raw = (column[i].as_py() or "").encode()
                    spans = np.zeros((0, 2), np.int64)
                    if lists[i].is_valid:
                        inner = lists.slice(i, 1).flatten()
                        start, windows, digest = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                        packed = inner.field(3)
                        total, inverse = _sums(np.frombuffer(raw, np.uint8))
                        end = start + windows + length - 1
                        # another text with the same key has other pieces there
                        own = np.flatnonzero(end <= len(raw))
                        own = own[mixed((total[end[own]] - total[start[own]]) * inverse[start[own]] + windows[own].astype(np.uint64)).view(np.int64) == digest[own]]
                        change = np.zeros(len(raw) + 1, np.int64)
                        whole = packed.is_null().to_numpy(zero_copy_only=False)[own]
                        np.add.at(change, start[own[whole]], 1)
                        np.add.at(change, end[own[whole]], -1)
                        for k in own[~whole].tolist():
                            at = start[k] + np.flatnonzero(np.unpackbits(np.frombuffer(packed[k].as_py(), np.uint8), count=windows[k]))
                            change[at] += 1
                            change[at + length] -= 1
                        gone = np.cumsum(change[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        spans = edge.reshape(-1, 2)
                    kept, at = [], 0
                    for a, b in spans.tolist():
                        kept.append(raw[at:a])
                        at = b
                    kept = b"".join([*kept, raw[at:]])
                    for held, x in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None)):
                        held.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, n), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (the remaining bytes) for every row."""
    rows = narrow(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64("id", "text"))
    pieces = stored(scan(rows, length, gram))
    repeated = stored(pieces.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"))
    places = stored(pieces.drop("times").join(repeated, "anchor"))
    discard(pieces, repeated)
    folded = stored(places.groupBy("anchor", "digest", "windows").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("key"), F.min_by("start", "key").alias("start")))
    different = stored(folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")))
    counted = stored(folded.join(different, "anchor").withColumn("crowded", F.col("pieces") > MOST_PIECES))
    discard(folded, different)
    settled = F.col("pieces") == 1, F.col("weight") > 1
    whole = counted.where(settled[0] & settled[1]).select("anchor", "digest", F.lit(None).cast("binary").alias("marks"))
    texts_of = stored(piece_texts(counted.where(~(settled[0] & settled[1])), rows, length))
    found = marks(texts_of.where("not crowded"), length)
    if not texts_of.where("crowded").isEmpty():
        found = found.unionByName(crowded_marks(texts_of.where("crowded"), length))
    found = stored(found)
    discard(texts_of)
    here = places.join(found.unionByName(whole), ["anchor", "digest"]).select("key", "start", "windows", "digest", "marks")
    out = cut_texts(rows, here, length, texts)
    return (out if texts else out.drop("kept")).withColumnRenamed("id", id_col)
