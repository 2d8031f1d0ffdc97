"""Byte-level BPE by a finite-state transducer, and streaming decoding by a UTF-8 machine.

Encoding.  The merges of a rank file are compiled into a transducer that reads the
bytes of a pre-token from left to right and writes token ids:

* Every token has one split (left, right) that its merges end with.  Two tokens stand
  ``apart`` when no merge along their border would come before those inside them.  A
  sequence of tokens is what merging by ranks gives exactly if each neighbouring pair
  stands apart; so each prefix of the bytes has one last token, and one encoding.
* Nondeterministically, a new token may begin at each byte: a configuration is (the
  token it stands beside, node in the trie of tokens).  A state of the determinised
  machine is the set of configurations that are alive, and each transition gives the
  last token of the encoding of what was read so far.
* Ids are written when all configurations that are alive descend from them.  One dies
  after as many bytes as the longest token has, so the lookahead is bounded; a
  pre-token below ``SETTLE`` bytes is written at its end.
* States and transitions are made when a byte first needs them and kept, up to
  ``MOST_STATES``; then the machine starts again from its first state.

The compiled splits are worked out once, on the driver; they are as many as the
vocabulary has tokens.  A tokenizer whose merges aren't such (a token that no merges
give) is served too: such a token is written only for a pre-token that equals it.

A text is cut into chunks at places where every match of the split pattern ends (the
end of a run without white space); the pattern runs on chunks that aren't in the memo.

Decoding.  ``Decoder`` takes ids as they come and gives bytes that end with a whole
character.  Its machine reads bytes; for whole tokens the steps are composed once.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lingoscope.llm.common import narrow, sparing, text_lists

MOST_STATES = 150_000
SETTLE = 1 << 10  # bytes that are read before ids are written
LOOKED_AT = 8  # tokens below a node from which on it is told which of them may stand there
MEMO_BYTES = 20 << 20  # what keys and values of the memo hold, without Python's own
LONG = 64  # characters above which a chunk isn't kept
SLICE = 1 << 20  # bytes of texts that become strings together
DECODED = 1 << 16  # ids that are decoded at a time

#: The characters that split patterns and Unicode take for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at the place of their rank."""
    with open(path, "rb") as f:
        held = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(held) != list(range(len(held))):
        raise ValueError("ranks must be without gaps")
    return [held[i] for i in range(len(held))]


class Merges(NamedTuple):
    """A compiled vocabulary: the tokens by rank and the split of each (-1: a byte, -2: no merges give it)."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray


class Borders:
    """Which pairs of tokens stay apart, as splits become known."""

    def __init__(self, n: int):
        self.left, self.right = [-1] * n, [-1] * n
        self.joins: list[dict[int, int]] = [{} for _ in range(n)]  # of each token: the right part -> what both make
        self._starts: dict[int, list] = {}
        self._ends: dict[int, list] = {}

    def split(self, token: int, left: int, right: int) -> None:
        self.left[token], self.right[token] = left, right
        if left >= 0:
            self.joins[left][right] = token

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the end of ``a`` with the start of ``b``.

        Tokens x at the end of a, and y at the start of b, would be joined if their
        merge comes before the one that takes up x, and not after the one that takes
        up y (of merges alike, the leftmost is first).
        """
        starts = self._starts.get(b) or self._on_the_way(b, self.left, self._starts)
        for x, before_x in self._ends.get(a) or self._on_the_way(a, self.right, self._ends):
            made = self.joins[x]
            if made:
                for y, before_y in starts:
                    if y in made and made[y] < before_x and made[y] <= before_y:
                        return False
        return True

    def _on_the_way(self, token: int, part: list[int], held: dict) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` while it is merged, each with the one that takes it up."""
        out, before, x = [], 1 << 60, token
        while x >= 0:
            out.append((x, before))
            before, x = x, part[x]
        held[token] = out
        return out


def compile_merges(tokens: list[bytes]) -> Merges:
    """The one split of each token into two of lower ranks that stand apart."""
    rank = {t: i for i, t in enumerate(tokens)}
    borders = Borders(len(tokens))
    for i, token in enumerate(tokens):
        if len(token) == 1:
            continue
        found = (-2, -2)
        for k in range(1, len(token)):
            a, b = rank.get(token[:k], i), rank.get(token[k:], i)
            if a < i and b < i and borders.left[a] != -2 and borders.left[b] != -2 and borders.apart(a, b):
                found = (a, b)
                break
        borders.split(i, *found)
    return Merges(tokens, np.array(borders.left, np.int32), np.array(borders.right, np.int32))


class Transducer:
    """The ids of a pre-token's bytes."""

    def __init__(self, merges: Merges, most_states: int = MOST_STATES, settle: int = SETTLE):
        self.most_states, self.settle = most_states, settle
        self.borders = Borders(len(merges.tokens))
        for i, (a, b) in enumerate(zip(merges.left.tolist(), merges.right.tolist())):
            self.borders.split(i, a, b)
        self.whole = {t: i for i, t in enumerate(merges.tokens)}
        self.length = list(map(len, merges.tokens))
        self.below: list[dict[int, int]] = [{}]  # the trie: node -> byte -> node
        self.token: list[int] = [-1]
        self.longer: list[list[int]] = [[]]  # tokens below a node, up to one more than LOOKED_AT
        for i, t in enumerate(merges.tokens):
            if merges.left[i] == -2:
                continue
            node = 0
            for byte in t:
                if len(self.longer[node]) <= LOOKED_AT:
                    self.longer[node].append(i)
                after = self.below[node].get(byte)
                if after is None:
                    after = self.below[node][byte] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                    self.longer.append([])
                node = after
            self.token[node] = i
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.first = self._state(((-1, 0, 0),))

    def _state(self, alive: tuple) -> tuple:
        """(transitions, configurations); a transition is a state and the last token of what was read."""
        state = self.known.get(alive)
        if state is None:
            state = self.known[alive] = ({}, alive)
        return state

    def _apart(self, a: int, b: int) -> bool:
        held = self.beside.get((a, b))
        if held is None:
            held = self.beside[a, b] = a < 0 or self.borders.apart(a, b)
        return held

    def _step(self, state: tuple, byte: int) -> tuple:
        """A configuration is (what its token stands beside, node, bytes of the token so far).

        What it stands beside is a token, and once few tokens are below the node, -2 - k,
        where the bits of k tell which of them may stand there.
        """
        alive, complete = [], -1
        for beside, node, n in state[1]:
            before = node
            node = self.below[node].get(byte)
            if node is None:
                continue
            token, longer = self.token[node], self.longer[node]
            if beside >= -1:
                may = token >= 0 and self._apart(beside, token)
                if len(longer) <= LOOKED_AT:
                    beside = -2 - sum(1 << k for k, t in enumerate(longer) if self._apart(beside, t))
            else:
                may_stand = {t for k, t in enumerate(self.longer[before]) if -2 - beside >> k & 1}
                may = token in may_stand
                beside = -2 - sum(1 << k for k, t in enumerate(longer) if t in may_stand)
            if may:
                complete = token
            if longer and beside != -2:
                alive.append((beside, node, n + 1))
        if complete < 0:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((complete, 0, 0))
        went = state[0][byte] = (self._state(tuple(alive)), complete)
        return went

    def ids(self, data: bytes) -> list[int]:
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        if len(self.known) > self.most_states:
            self._forget()
        if len(data) <= self.settle:
            state, last = self.first, []
            for byte in data:
                went = state[0].get(byte) or self._step(state, byte)
                state = went[0]
                last.append(went[1])
            return self._back(last, len(last))
        return self._settled(data)

    def _back(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, from the last token of each beginning."""
        out, length = [], self.length
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def _settled(self, data: bytes) -> list[int]:
        """As ``ids``; a stretch at a time, writing what all configurations that are alive share."""
        out: list[int] = []
        state, last = self.first, []
        for byte in data:
            went = state[0].get(byte) or self._step(state, byte)
            state = went[0]
            last.append(went[1])
            if len(last) >= self.settle:
                # a token that has begun n bytes ago stands behind the encoding of what came before
                shared = None
                for _, _, n in state[1]:
                    ids = self._back(last, len(last) - n)
                    shared = ids if shared is None else shared[: next((k for k, (a, b) in enumerate(zip(shared, ids)) if a != b), min(len(shared), len(ids)))]
                out += shared
                last = last[sum(self.length[t] for t in shared) :]
                if len(self.known) > self.most_states:
                    alive = state[1]
                    self._forget()
                    state = self._state(alive)
        return out + self._back(last, len(last))


class Encoder:
    """Packed ids (two bytes each, as the machine has them) of texts."""

    def __init__(self, merges: Merges, pattern: str, memo_bytes: int = MEMO_BYTES):
        import re

        import regex

        if len(merges.tokens) > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.machine = Transducer(merges)
        self.split = regex.compile(pattern).findall
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+").findall
        self.memo: dict[str, bytes] = {}
        self.held, self.memo_bytes = 0, memo_bytes

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, or of one match, that the memo lacks."""
        matches = [chunk] if chunk.removeprefix(" ").isalpha() else self.split(chunk)  # letters alone are one match
        if len(matches) == 1:
            packed = array("H", self.machine.ids(chunk.encode())).tobytes()
        else:
            get = self.memo.get
            packed = b"".join([get(m) or self.chunk(m) for m in matches])
        if len(chunk) <= LONG:
            self.held += len(chunk) + len(packed)
            if self.held > self.memo_bytes:
                self.memo.clear()
                self.held = len(chunk) + len(packed)
            self.memo[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        get, make = self.memo.get, self.chunk
        return b"".join([get(c) or make(c) for c in self.chunks(text)])


#: States of the UTF-8 machine: (bytes of the character so far, the range of the next one, how many follow that).
#: Fixed values of the encoding's definition: which second bytes may follow the first.
FIRST = [((0xC2, 0xDF), (0x80, 0xBF), 0), ((0xE0, 0xE0), (0xA0, 0xBF), 1), ((0xE1, 0xEC), (0x80, 0xBF), 1), ((0xED, 0xED), (0x80, 0x9F), 1), ((0xEE, 0xEF), (0x80, 0xBF), 1),
         ((0xF0, 0xF0), (0x90, 0xBF), 2), ((0xF1, 0xF3), (0x80, 0xBF), 2), ((0xF4, 0xF4), (0x80, 0x8F), 2)]
BROKEN = 255


@lru_cache(maxsize=1)
def utf8_machine() -> tuple[list[tuple], list[bytes]]:
    """The states as above (the first is between characters) and the state after each byte."""
    states: list[tuple] = [()]
    for _, allowed, more in FIRST:
        for k in range(more + 1):
            state = (1 + k, allowed if k == 0 else (0x80, 0xBF), more - k)
            if state not in states:
                states.append(state)
    start = bytearray([0] * 128 + [BROKEN] * 128)
    for (low, high), allowed, more in FIRST:
        start[low : high + 1] = bytes([states.index((1, allowed, more))] * (high + 1 - low))
    after = [bytes(start)]
    for seen, (low, high), more in states[1:]:
        row = bytearray([BROKEN] * 256)
        row[low : high + 1] = bytes([states.index((seen + 1, (0x80, 0xBF), more - 1)) if more else 0] * (high + 1 - low))
        after.append(bytes(row))
    return states, after


class Decoder:
    """Bytes of ids as they come, held back to the last whole character.

    Bytes that are no UTF-8 pass as they are, or are replaced by U+FFFD, one for each
    longest beginning of a character, if ``replace``.
    """

    def __init__(self, tokens: list[bytes], replace: bool = False):
        self.tokens, self.replace = tokens, replace
        self.states, self.after = utf8_machine()
        self.steps = [bytes(self._over(s, t) for t in tokens) for s in range(len(self.states))]
        self.whole = np.frombuffer(self.steps[0], np.uint8) == 0  # tokens of whole characters
        self.restart()

    def restart(self) -> None:
        self.state, self.tail = 0, b""

    def _over(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.after[state][byte]
            if state == BROKEN:
                return BROKEN
        return state

    def feed(self, ids) -> bytes:
        steps, state = self.steps, self.state
        data = self.tail + b"".join(map(self.tokens.__getitem__, ids))
        if state == 0 and self.whole[np.asarray(ids, np.intp)].all():
            return data
        for i in ids:
            state = steps[state][i]
            if state == BROKEN:
                return self._byte_by_byte(data)
        seen = self.states[state][0] if state else 0
        self.state, self.tail = state, data[len(data) - seen :]
        return data[: len(data) - seen]

    def _byte_by_byte(self, data: bytes) -> bytes:
        out, state, begun = bytearray(), 0, 0
        for at, byte in enumerate(data):
            now = self.after[state][byte]
            if now == BROKEN and state:  # what had begun is broken; the byte may begin another
                out += "�".encode() if self.replace else data[begun:at]
                begun, now = at, self.after[0][byte]
            if now == BROKEN:
                out += "�".encode() if self.replace else data[at : at + 1]
                now = 0
                begun = at + 1
            elif now == 0:
                out += data[begun : at + 1]
                begun = at + 1
            state = now
        self.state, self.tail = state, data[begun:]
        return bytes(out)

    def close(self) -> bytes:
        """What was held back; the next ids begin anew."""
        rest = self.tail and ("�".encode() if self.replace else self.tail)
        self.restart()
        return rest


_held: dict[str, tuple] = {}


def workers_own(key: str, make):
    """What a worker keeps between its tasks, one of a kind."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def encoded(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (array of int) of every whole text; a null text has no ids."""
    merges = compile_merges(tokens)
    key = _name("encode", merges, pattern)

    @sparing
    def encode(batches):
        encoder = workers_own(key, lambda: Encoder(merges, pattern))
        for batch in batches:
            for start, texts in text_lists(batch.column("text"), SLICE):
                packed = [encoder.packed(t) for t in texts]
                ends = np.cumsum([0, *(len(p) // 2 for p in packed)])
                values = np.frombuffer(b"".join(packed), np.uint16).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(texts)), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                    names=["id", "n_tokens", "ids"],
                )

    rows = narrow(docs, id=id_col, text=text_col)
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, tokens: list[bytes], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of lists of ids; bytes that are no UTF-8 become U+FFFD, null lists are null.

    Ids outside the vocabulary and null ids are errors.
    """
    key = _name("decode", tokens)

    @sparing
    def decode(batches):
        decoder = workers_own(key, lambda: Decoder(tokens, replace=True))
        for batch in batches:
            texts = [None if ids is None else b"".join([decoder.feed(ids), decoder.close()]).decode() for ids in (x.as_py() for x in batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    given = narrow(rows, id=id_col, ids=ids_col)
    return given.mapInArrow(decode, f"id {given.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def _name(*parts) -> str:
    return hashlib.md5(json.dumps(parts, default=lambda x: x.hex() if isinstance(x, bytes) else x.tolist()).encode()).hexdigest()


def round_trips(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of decimal ids with commas between), decoded_sha256 (of the bytes that the ids decode to).

    A null text counts as empty.  Ids pass through as they are, nulls and repetitions
    included; other columns are dropped, whatever their names; an empty table gives
    an empty result.  Ids of a text are written and hashed a stretch at a time.
    """
    merges = compile_merges(tokens)
    key = _name("both", merges, pattern)

    @sparing
    def digests(batches):
        encoder, decoder, decimal = workers_own(key, lambda: (Encoder(merges, pattern), Decoder(merges.tokens), list(map(str, range(len(merges.tokens))))))
        for batch in batches:
            n, hashes, back = [], [], []
            for _, texts in text_lists(batch.column("text"), SLICE):
                for text in texts:
                    ids = memoryview(encoder.packed(text)).cast("H")
                    written, bytes_ = hashlib.sha256(), hashlib.sha256()
                    for k in range(0, len(ids), DECODED):
                        some = ids[k : k + DECODED]
                        written.update(("," if k else "").encode())
                        written.update(",".join(map(decimal.__getitem__, some)).encode())
                        bytes_.update(decoder.feed(some))
                    bytes_.update(decoder.close())
                    n.append(len(ids))
                    hashes.append(written.hexdigest())
                    back.append(bytes_.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrow(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(digests, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
