"""Token ids and counts of a word-level BPE tokenizer, exactly as its library gives them.

The tokenizer's file is read at a path that is a parameter.  Its pipeline is
NFC, white space to blanks, lower case; a split into pre-tokens; then merges of
byte symbols whose last one carries an end-of-word mark.  White space separates
pre-tokens always, so a text is a list of chunks without white space, and the
ids of a chunk depend on nothing else.  That makes them memoisable.  The chunks of
some texts are numbered by Arrow, and only distinct ones are looked up; a text's ids
are then gathered by its chunks' numbers.

* Whole-token shortcut: on loading, every vocabulary string that ends a word is
  encoded by the library; those that come out as their one id form the table of
  proven whole tokens.  A pre-token in the table is one token without any merge.
* A chunk of letters and perhaps signs after them is two pre-tokens at most; its
  parts are found by Arrow, for all new chunks at once.
* Other pre-tokens are merged, a batch at a time, by rank in numpy; one of more
  than ``LONG_RUN`` bytes is merged by the library, whose time is near linear in
  its length (each numpy round rewrites the whole row, so the time is quadratic).
* A chunk with a character at or above U+0180, or with the opening of a special
  token, goes to the library as it is.  Below U+0180 all characters are their
  own NFC form and lower-case and class rules are those in ``SPLIT``; a test
  holds these against the library for every such character.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lingoscope.llm.common import byte_sized, narrow, sparing, utf8_of

#: Fixed values of the tokenizer's own split, for characters below U+0180.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſà-öÀ-ÖØ-Þ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ſÀ-ÖØ-Þ0-9²³¹¼½¾]+")
PLAIN = re.compile(r"(?:[!-;=-~¡-¬®-ſ]|<(?!\|))+\Z")  # no controls, no opening of a special token
#: Letters whose lower case is one letter of the split, and signs that form one pre-token after letters (not "<", which may open a special token).
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµº" + "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130))
SIGNS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: White space that str.split() takes for a separator and the tokenizer doesn't.
UNLIKE = "\x1c\x1d\x1e\x1f"
CHUNK = re.compile(r"[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")
MEMO = 300_000
TOGETHER = 1 << 21  # bytes of texts that are tokenised together
LONG = 48  # chunks above this length aren't memoised
LONG_RUN = 256  # bytes of a pre-token from which the library merges it
END = "</w>"
NONE = np.int32(2**31 - 1)


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in UNLIKE):
        return CHUNK.findall(text)
    return text.split()


def listed(column: pa.Array) -> list:
    """What ``to_pylist`` gives of a column without nulls, in a tenth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def numbered_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounds of each text's chunks, their numbers, and the distinct chunks by number.

    An empty string stands for nothing, at white space with which a text begins or ends.
    """
    texts = texts.fill_null("")
    data, _ = utf8_of(texts)
    if ((data >= 0x1C) & (data <= 0x1F)).any():
        lists = pa.array(map(chunks_of, listed(texts)), pa.large_list(pa.large_string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], coded.indices.to_numpy(), listed(coded.dictionary)


class Bpe:
    """The ids of chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        model = json.loads(raw)["model"]
        self.library = Tokenizer.from_str(raw)
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._byte_symbols(vocab)
        self._merge_table(model["merges"], vocab)
        self.whole = self._whole_tokens(vocab)
        self.memo: dict[str, bytes] = {}

    def _byte_symbols(self, vocab) -> None:
        # byte-level alphabets print each byte as one visible character
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in visible}
        char |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in char)}
        self.byte_of = {c: b for b, c in char.items()}
        self.inner = np.array([vocab.get(char[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(char[b] + END, -1) for b in range(256)], np.int64)

    def _merge_table(self, merges, vocab) -> None:
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, NONE, np.int32)
        slots = self._slot(keys)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist())):
            while self.slot_key[slot] >= 0:
                slot += 1
            self.slot_key[slot], self.slot_rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -2)
        slot = self._slot(keys)
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_rank[slot], NONE)
        open_ = np.nonzero((held != keys) & (held >= 0) & (keys >= 0))
        while len(open_[0]):
            slot[open_] += 1
            held = self.slot_key[slot[open_]]
            hit = held == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.slot_rank[slot[open_]][hit]
            open_ = tuple(x[~hit & (held >= 0)] for x in open_)
        return out

    def _whole_tokens(self, vocab) -> dict[str, bytes]:
        """Strings that are proven, by the library, to encode alone as one token."""
        found: dict[str, bytes] = {}
        texts, ids = [], []
        for token, i in vocab.items():
            if token.endswith(END):
                try:
                    text = bytes(self.byte_of[c] for c in token[: -len(END)]).decode("utf-8")
                except (UnicodeDecodeError, KeyError):
                    continue
                if text and SPLIT.fullmatch(text) and PLAIN.match(text):
                    texts.append(text)
                    ids.append(i)
        for text, i, got in zip(texts, ids, self.library.encode_batch(texts, add_special_tokens=False)):
            if got.ids == [i]:
                found[text] = self._pack([i])
        return found

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens by merges alone, words of one byte length together."""
        coded = [w.encode() for w in words]
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            length = int(lengths[at[0]])
            for k in range(0, len(at), per := max(1, 400_000 // length)):
                some = at[k : k + per].tolist()
                raw = np.frombuffer(b"".join([coded[i] for i in some]), np.uint8).reshape(len(some), length)
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                if (ids < 0).any():
                    raise ValueError("the vocabulary lacks a byte symbol")
                done = self._merged(ids)
                held = (done >= 0).sum(1)
                packed = done[done >= 0].astype(self.kind).tobytes()
                ends = (np.cumsum(held) * self.kind.itemsize).tolist()
                start = 0
                for i, end in zip(some, ends):
                    out[i] = packed[start:end]
                    start = end
        return out

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """Always the pair of lowest rank, the leftmost of equal ones."""
        n, length = ids.shape
        if length == 1:
            return ids
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        done = np.full((n, length), -1, np.int64)
        rows = np.arange(n)
        column = np.arange(length)
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            over = best == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                keep = ~over
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            width = ids.shape[1]
            ids[line, at] = self.made[best]
            if width == 2:
                done[rows, 0] = ids[:, 0]
                break
            take = column[: width - 1] + (column[: width - 1] > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], width - 2), 1)
            left, right = at - 1, at
            has = left >= 0
            ranks[line[has], left[has]] = self._ranks(ids[line[has], left[has]], ids[line[has], left[has] + 1])
            has = right < width - 2
            ranks[line[has], right[has]] = self._ranks(ids[line[has], right[has]], ids[line[has], right[has] + 1])
        return done

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _merged_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct pre-tokens."""
        whole = self.whole
        rest = [w for w in words if w not in whole]
        long = {w for w in rest if 4 * len(w) > LONG_RUN and len(w.encode()) > LONG_RUN}
        rest = [w for w in rest if w not in long] if long else rest
        merged = dict(zip(rest, self.merge(rest)))
        merged.update((w, self._pack(e.ids)) for w, e in zip(long, self.library.encode_batch(list(long), add_special_tokens=False)))
        return [whole[w] if w in whole else merged[w] for w in words]

    def _resolve(self, chunks) -> dict[str, bytes]:
        """Packed ids of chunks, none of them in the memo."""
        chunks = pa.array(chunks, pa.large_string())
        core, tail = pc.ascii_rtrim(chunks, SIGNS), pc.utf8_ltrim(chunks, LETTERS)
        # letters with nothing but signs after them: of any other chunk the two overlap or leave a gap
        simple = pc.and_(pc.equal(pc.add(pc.binary_length(core), pc.binary_length(tail)), pc.binary_length(chunks)), pc.not_equal(core, ""))
        others = listed(chunks.filter(pc.invert(simple)))
        chunks, core, tail = (x.filter(simple) for x in (chunks, core, tail))
        words, tails = pc.utf8_lower(core).dictionary_encode(), tail.dictionary_encode()
        split = {c: SPLIT.findall(c.lower()) for c in others if PLAIN.match(c)}
        first, then = listed(words.dictionary), listed(tails.dictionary)
        distinct = list(set(first).union(then, *split.values()) - {""})
        ids = dict(zip(distinct, self._merged_words(distinct)))
        ids[""] = b""
        first, then = [ids[w] for w in first], [ids[w] for w in then]
        out = {c: first[i] + then[j] for c, i, j in zip(listed(chunks), listed(words.indices), listed(tails.indices))}
        out.update((c, b"".join([ids[w] for w in parts])) for c, parts in split.items())
        odd = [c for c in others if c not in split]
        out.update((c, self._pack(e.ids)) for c, e in zip(odd, self.library.encode_batch(odd, add_special_tokens=False)))
        return out

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        packed = list(map(self.memo.get, chunks))
        new = {c for c, ids in zip(chunks, packed) if ids is None and c}
        if len(self.memo) + len(new) > MEMO:
            # what these texts need of it stays, if they leave it room
            fits = len(chunks) - ("" in chunks) <= MEMO
            self.memo = {c: ids for c, ids in zip(chunks, packed) if ids is not None} if fits else {}
        if new:
            fresh = self._resolve(new)
            packed = [fresh.get(c, b"") if ids is None else ids for c, ids in zip(chunks, packed)]
            if len(fresh) > MEMO or max(map(len, fresh)) > LONG:  # rare: what must not stay in the memo is known for these texts only
                fresh = dict(list((c, ids) for c, ids in fresh.items() if len(c) <= LONG)[:MEMO])
            self.memo.update(fresh)
        return [ids or b"" for ids in packed]

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        bounds, numbers, chunks = numbered_chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        packed = self._known(chunks)
        flat = np.frombuffer(b"".join(packed), self.kind)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        starts, sizes = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.split(out, ends[bounds[1:-1]]) if len(bounds) > 1 else []

    def counts(self, texts: list[str] | pa.Array) -> list[int]:
        bounds, numbers, chunks = numbered_chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        sizes = np.fromiter(map(len, self._known(chunks)), np.int64, len(chunks)) // self.kind.itemsize
        ends = np.concatenate(([0], np.cumsum(sizes[numbers])))
        return np.diff(ends[bounds]).tolist()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every whole text.

    Null text counts as empty: no bytes, no tokens.  Ids pass through as they
    are, nulls and repetitions included; an empty table gives an empty result.
    """

    @sparing
    def count(batches):
        tokenizer = bpe(path)
        for batch in batches:
            n = [c for start, k in byte_sized(batch.column("text"), TOGETHER) for c in tokenizer.counts(batch.column("text").slice(start, k))]
            size = np.diff(utf8_of(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = narrow(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
