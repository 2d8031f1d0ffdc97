"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

All strings of a collection grow together, from their ends: round j inserts, for
every string that is long enough, the suffix of j symbols.  Its place follows
from the transform: the symbol before the string's last inserted suffix, read
from the transform there, says in which run of suffixes it goes, and the place
of that suffix says where in the run.  Common prefixes with the neighbours are
one more than the smallest common prefix between the neighbours' tails.

The sorted suffixes are kept as columns in files: link (first symbol and place
of the tail), before (the transform: symbol in front), common (common prefix
with the suffix above), where (place in the collection).  A round reads each
file from start to end through a buffer of ``BUFFER`` entries, merges its
insertions and writes the next file; nothing is sought.  In memory are the
strings themselves and what one round inserts, so the columns, some twenty times
as large, may exceed it.

A symbol is a word of a few bytes, taken as the number that the bytes are, so a
byte string gives as many strings of words as a word has bytes, one for each
phase, and every byte's suffix is among them.  Prefixes are compared to whole
words, which decides the lengths that are multiples of a word.  (Words of more
than ``RAW`` bytes don't fit a link; they are numbered in their order first.)
"""

from __future__ import annotations

import tempfile

import numpy as np

WORD = 5
RAW = 5
PLACE = 23  # bits of a place in a link: suffixes of one collection
LOW = (1 << PLACE) - 1
BUFFER = 1 << 18
_KINDS = {"link": np.int64, "before": np.int64, "common": np.uint8, "where": np.int32}


class Columns:
    """The columns: each is read from one file and written to another, which then change places."""

    def __init__(self):
        self.n = 0
        self.old = {name: tempfile.TemporaryFile(buffering=0) for name in _KINDS}
        self.new = {name: tempfile.TemporaryFile(buffering=0) for name in _KINDS}

    def start(self, *names: str) -> None:
        for name in names:
            self.old[name].seek(0)

    def read(self, name: str, n: int) -> np.ndarray:
        """The next ``n`` entries."""
        out = np.empty(n, _KINDS[name])
        view = memoryview(out).cast("B")
        while len(view):
            got = self.old[name].readinto(view)
            if not got:
                raise EOFError(name)
            view = view[got:]
        return out

    def write(self, **columns: np.ndarray) -> None:
        for name, column in columns.items():
            view = memoryview(np.ascontiguousarray(column, _KINDS[name])).cast("B")
            while len(view):
                view = view[self.new[name].write(view) :]

    def turn(self, n: int) -> None:
        """What was written is what will be read."""
        self.old, self.new, self.n = self.new, self.old, n
        for file in self.new.values():
            file.seek(0)

    def parts(self):
        return [(a, min(a + BUFFER, self.n)) for a in range(0, self.n, BUFFER)]

    def close(self) -> None:
        for file in [*self.old.values(), *self.new.values()]:
            file.close()


class Lowest:
    """The smallest value in ranges of a column of bytes, none longer than ``most``."""

    def __init__(self, column: np.ndarray, most: int):
        levels = [column]
        width = 1
        while 2 * width <= min(most, len(column)):
            top = levels[-1]
            levels.append(np.minimum(top[: len(top) - width], top[width:]))
            width *= 2
        # all levels side by side, so that a query is two looked-up bytes
        self.starts = np.cumsum([0, *(len(x) for x in levels)])[:-1]
        self.flat = np.concatenate(levels)

    def between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Smallest of column[first:end], each range holding one value at least."""
        level = np.frexp((end - first).astype(np.float64))[1] - 1
        base = self.starts[level]
        return np.minimum(self.flat[base + first], self.flat[base + end - (1 << level)])


def lowest_in(columns: Columns, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest common prefix in each range [first, end) of the column, in one pass."""
    out = np.full(len(first), 255, np.uint8)
    if not len(first):
        return out
    columns.start("common")
    whole = []
    order, by_end = np.argsort(first), np.argsort(end)
    starts, ends = first[order], end[by_end]
    for a, b in columns.parts():
        column = columns.read("common", b - a)
        whole.append(column.min())
        here = order[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
        late = by_end[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "right")]
        late = late[first[late] < a]
        some = np.concatenate([here, late])
        if not len(some):
            continue
        low, high = np.maximum(first[some], a) - a, np.minimum(end[some], b) - a
        out[some] = np.minimum(out[some], Lowest(column, int((high - low).max())).between(low, high))
    if len(whole) > 2:
        low, high = -(-first // BUFFER), end // BUFFER  # the whole parts in between
        wide = np.flatnonzero(high > low)
        if len(wide):
            out[wide] = np.minimum(out[wide], Lowest(np.array(whole, np.uint8), len(whole)).between(low[wide], high[wide]))
    return out


def _ranked(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the values, equal for equal ones."""
    order = np.argsort(values)
    held = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1])))
    return rank


def raw_words(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The ``width`` bytes at each place as a number, high byte first; bytes after the end are 0."""
    out = np.zeros(len(at), np.int64)
    for k in range(width):
        here = at + k
        out = (out << 8) + np.where(here < len(data), data[np.minimum(here, len(data) - 1)], 0)
    return out


def codes(data: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` bytes at each place, ordered as the bytes are."""
    every = np.arange(len(data))
    if width <= RAW:
        return raw_words(data, width, every)
    head, tail = _ranked(raw_words(data, RAW, every)), codes(data, width - RAW)
    after = np.zeros(len(data), np.int64)
    after[: max(0, len(data) - RAW)] = _ranked(tail)[RAW:]
    return _ranked((head << 31) + after)


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, common): byte places in the order of their suffixes, and the words shared with the one above.

    The strings are ``data[start : start + length]``.
    """
    word = word or WORD
    if len(lengths) and int(lengths.max()) // word > 250:
        raise ValueError("strings must have at most 250 words")
    if int(np.maximum(lengths + 1, 0).sum()) + word * len(lengths) > LOW:
        raise ValueError(f"a collection must have less than {LOW} suffixes")
    table = None if word <= RAW else codes(data, word)

    def symbols(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The symbol at each place, from 1; 0 in front of a string."""
        out = (raw_words(data, word, np.maximum(at, 0)) if table is None else table[np.maximum(at, 0)]) + 1
        out[at < begin] = 0
        return out

    # a strand for each string and phase that has a symbol; all start with an empty suffix
    phase = np.tile(np.arange(word), len(starts))
    begin, end = np.repeat(starts, word), np.repeat(starts + lengths, word) - phase
    some = end - word >= begin
    begin, end = begin[some].astype(np.int64), end[some].astype(np.int64)
    k = len(end)
    columns = Columns()
    try:
        # an empty suffix has no first symbol: its link is negative, stays as it is and sorts first
        columns.write(link=np.arange(-k, 0), before=symbols(end - word, begin), common=np.zeros(k, np.uint8), where=-np.ones(k))
        columns.turn(k)
        last, places = np.arange(k), end  # where the suffixes of the last round are in the order, and in the strings
        while len(last):
            last, places, begin = inserted(columns, last, places, begin, symbols, word)
        columns.start("where", "common")
        where, common = columns.read("where", columns.n), columns.read("common", columns.n)
    finally:
        columns.close()
    return where[k:].astype(np.int64), common[k:]  # the empty suffixes share nothing with what follows them


def inserted(columns: Columns, last: np.ndarray, places: np.ndarray, begin: np.ndarray, symbols, word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: a suffix one symbol longer for each strand that has another; (last, places, begin) for the next."""
    n = columns.n
    # the symbols in front, read from the transform; ``last`` ascends
    columns.start("before")
    front = np.empty(len(last), np.int64)
    for a, b in columns.parts():
        low, high = np.searchsorted(last, [a, b])
        front[low:high] = columns.read("before", b - a)[last[low:high] - a]
    active = np.flatnonzero(front)
    if not len(active):
        return last[:0], places[:0], begin[:0]
    key = (front[active] << PLACE) + last[active]
    order = np.argsort(key, kind="stable")
    key, of = key[order], active[order]
    places, begin = places[of] - word, begin[of]

    # where they go, and the links of what will stand above and below
    k = len(key)
    position, above, below = np.full(k, n), np.empty(k, np.int64), np.full(k, -1)
    columns.start("link")
    done, upper = 0, -1
    for a, b in columns.parts():
        link = columns.read("link", b - a)
        high = int(np.searchsorted(key, link[-1], "right"))
        at = np.searchsorted(link, key[done:high])
        position[done:high], below[done:high] = a + at, link[at]
        above[done:high] = np.where(at > 0, link[at - 1], upper)  # empty suffixes come first, so there is always one above
        done, upper = high, link[-1]
    above[done:] = upper
    chained = np.zeros(k, bool)
    chained[1:] = position[1:] == position[:-1]  # another insertion in the same gap stands above
    above[chained] = key[np.flatnonzero(chained) - 1]
    final = np.flatnonzero(np.append(position[1:] != position[:-1], True) & (position < n))

    # common prefixes with the neighbours: tails of one symbol share one more than their own least
    upper, lower = np.concatenate([above, key[final]]), np.concatenate([key, below[final]])
    alike = np.flatnonzero((upper >> PLACE) == (lower >> PLACE))
    shared = np.zeros(len(upper), np.uint8)
    shared[alike] = 1 + lowest_in(columns, (upper[alike] & LOW) + 1, (lower[alike] & LOW) + 1)
    fresh, changed = shared[:k], shared[k:]

    # merge everything, file by file
    moved = np.cumsum(np.bincount(position, minlength=n + 1)) if n <= BUFFER else None

    def shift(place: np.ndarray) -> np.ndarray:
        """How many insertions are at or above each place."""
        return np.searchsorted(position, place, "right") if moved is None else moved[place]

    new = {"link": key + shift(key & LOW), "before": symbols(places - word, begin), "common": fresh, "where": places}
    columns.start(*_KINDS)
    parts = columns.parts()
    for a, b in parts:
        low, high = np.searchsorted(position, [a, n + 1 if b == n else b])
        here = position[low:high] - a + np.arange(high - low)
        old = np.ones(b - a + high - low, bool)
        old[here] = False
        for name in _KINDS:
            column = columns.read(name, b - a)
            if name == "link":
                inner = int(np.searchsorted(column, 0))  # links of empty suffixes don't move
                column[inner:] += shift(column[inner:] & LOW)
            if name == "common":
                x, y = np.searchsorted(position[final], [a, b])
                column[position[final[x:y]] - a] = changed[x:y]
            out = np.empty(len(old), _KINDS[name])
            out[old] = column
            out[here] = new[name][low:high]
            columns.write(**{name: out})
    columns.turn(n + k)
    return position + np.arange(k), places, begin


def repeated_places(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Places whose ``length`` bytes also start elsewhere in the collection.

    A string of weight w stands for w equal ones.
    """
    word = next(w for w in range(min(WORD, length), 0, -1) if length % w == 0)
    place, common = sorted_suffixes(data, starts, lengths, word)
    if not len(place):
        return place
    string = np.searchsorted(starts, place, "right") - 1
    fits = place + length <= starts[string] + lengths[string]
    group = np.cumsum(common < length // word) - 1
    total = np.bincount(group, weights[string] * fits)
    return np.sort(place[fits & (total[group] >= 2)])
