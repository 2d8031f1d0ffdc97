"""Toxicity of texts that may be obfuscated: a noisy channel, decoded before scoring.

1. Character model: every task counts the character 4-grams of its texts (all
   texts, whole); summed, these give a smoothed model of what plain writing looks
   like.  There are at most 27 ** 4 of them.
2. Channel: a written character stands for itself, for a letter it resembles
   (leetspeak), for nothing (separators and decoration), or it repeats the one
   before; between single letters set apart by blanks, each blank may stand for
   nothing or for the end of a word.  Each choice has
   a cost; Viterbi finds the reading of least cost and highest probability.
3. Score: words of the text as written and as restored, and their beginnings,
   are the features of a logistic regression learnt from labels; a feature's
   value is the root of the number of different words that show it.

Weights are learnt from at most ``SAMPLE_DOCS`` labelled documents of the folds
that may be learnt from, picked by a hash of the id; copies of one text count
once.  At most ``FEATURES`` features are kept.  Those are the bounds of the fit.

Chunks between blanks are read independently of each other.  A look at the bytes of
all texts leaves out those that have nothing to restore and no word that begins as a
feature does; the others' hits are memoised.  Only a chunk with something to restore
is decoded.

Cases: null text counts as empty; an empty text is scored like a text without
hits; null labels and ids are never learnt from; without labels of both kinds
every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, namedtuple
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.common import bounded_sample, byte_sized, fold_of, narrow, sparing, text_lists, utf8_of

SAMPLE_DOCS = 20_000
FEATURES = 2_048
LEAST_G2 = 15.0  # evidence a feature needs; about one in 10 ** 4 by chance, which the ridge then weighs
MEMO = 150_000
GROUP = 1 << 20  # bytes of texts that are read together

#: Fixed values of the channel: what a sign may stand for, and what that costs (in nats).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
LEET_COST = 1.0
DROP_COST = {"digit": 6.0, "mark": 0.7}
COLLAPSE_COST = 0.3
MARKS = set("@$!|+(.-_*~'#%&^=,;:)")

#: Letters with a mark, and the plain letters that the model sees.
ACCENTED = str.maketrans(
    "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy", ""
)
ACCENTED[ord("ß")] = "ss"
ACCENTED[ord("œ")] = "oe"
ACCENTED[ord("æ")] = "ae"

WORD = re.compile(r"[a-z]+")
SPAN = re.compile(r"[a-z0-9@$!|+(€.\-_*~'#%&^=,;:)]+")
SPACED = re.compile(SPAN.pattern.replace("[", "[ ", 1))
ONE_LETTER = re.compile(r"[\W_]*[^\W_][\W_]*")
EDGE = "`"  # the letter before a: symbol 0 of the model, a word's edge
NEEDS = re.compile(r"[a-z][^a-z\s]+[a-z]|[0-9@$!|+(€][a-z]|[a-z][0-9@$!|+(€]|([a-z])\1\1")

#: What str.split takes for blanks, beyond ASCII.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
SIGN = DIGIT | np.isin(np.arange(256), list(b"@$!|+("))

Model = namedtuple("Model", "log4 weights bias")


# ---------------------------------------------------------------- the character model


def _symbols() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    return table


def _after_c3() -> np.ndarray:
    """Symbols of the second byte of U+00C0 to U+00FF, by their plain letters."""
    table = np.zeros(256, np.uint8)
    for cp in range(0xC0, 0x100):
        plain = chr(cp).lower().translate(ACCENTED)
        if "a" <= plain[0] <= "z":
            table[cp - 0xC0 + 0x80] = ord(plain[0]) - 96
    return table


SYMBOL, AFTER_C3 = _symbols(), _after_c3()
#: The same without letters that are written as two.
ONE_AFTER_C3 = AFTER_C3.copy()
ONE_AFTER_C3[[ord(c) - 0xC0 + 0x80 for c in "ßÆæ"]] = 0


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the 4-grams (base 27; 0 is a word's edge) in UTF-8 bytes."""
    s = SYMBOL[data]
    lead = data == 0xC3
    if lead.any():
        after = np.flatnonzero(lead[:-1]) + 1
        s[after] = AFTER_C3[data[after]]
        s = s[~lead]
    if not len(s):
        return np.zeros(27**4, np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = np.concatenate([np.zeros(1, np.uint8), s[keep], np.zeros(1, np.uint8)]).astype(np.int32)
    if len(s) < 4:
        return np.zeros(27**4, np.int64)
    code = ((s[:-3] * 27 + s[1:-2]) * 27 + s[2:-1]) * 27 + s[3:]
    return np.bincount(code, minlength=27**4)


def corpus_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """4-gram counts of all texts; each task hands on its sums."""

    def count(batches):
        total = np.zeros(27**4, np.int64)
        for batch in batches:
            for start, n in byte_sized(batch.column("text"), 1 << 19):
                data, bounds = utf8_of(batch.column("text").slice(start, n))
                # a blank between texts, so that no gram spans two
                data = np.insert(data, bounds[1:-1], 32) if n > 1 else data
                total += gram_counts(data)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes], pa.int64())], names=["code", "n"])

    rows = narrow(docs, text=text_col).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**4, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


def log_model(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """log P(symbol | three before), each order smoothed with the next lower one."""
    c = counts.astype(np.float64).reshape(27, 27, 27, 27)
    p = np.full(27, 1 / 27)
    lower = c.sum((0, 1, 2))
    p = (lower + strength * p) / (lower.sum() + strength)
    for order in (2, 3, 4):
        grams = c.sum(tuple(range(4 - order)))
        p = (grams + strength * p) / (grams.sum(-1, keepdims=True) + strength)
    return np.log(p).astype(np.float32).reshape(-1)


# ---------------------------------------------------------------- decoding


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Readings of each place: (letters, cost).  A run of three or more counts as one place, with or without blanks in it."""
    out, i = [], 0
    while i < len(span):
        c = span[i]
        j = i
        while j < len(span) and span[j] == c:
            j += 1
        n = j - i
        if c == " ":
            out.append([("", 0.0), (EDGE, 0.0)])
            i = j
            continue
        far, total = j, n
        while span[far : far + 2] == " " + c:
            far, total = far + 2, total + 1
        if total >= 3:
            j, n = far, total
        if "a" <= c <= "z":
            if n >= 3:
                out.append([(c, COLLAPSE_COST), (c * 2, COLLAPSE_COST)])
            else:
                out.extend([[(c, 0.0)]] * n)
        else:
            one = [("", DROP_COST["digit" if c.isdigit() else "mark"])] + [(x, LEET_COST) for x in LEET.get(c, "")]
            if n >= 3:
                out.append(one)
            else:
                out.extend([one] * n)
        i = j
    return out


def decode(span: str, log4: np.ndarray) -> str:
    """The likeliest reading of a span, as letters and edges of words (Viterbi over the last three)."""
    states = {0: (0.0, None)}  # the last three symbols, base 27 -> (score, (what came before, letters))
    for place in lattice(span):
        then: dict[int, tuple] = {}
        for context, (score, path) in states.items():
            for letters, cost in place:
                s, k = score - cost, context
                for x in letters:
                    if x == EDGE and k % 27 == 0:  # a word has just ended, or none has begun
                        continue
                    code = k * 27 + ord(x) - 96
                    s += float(log4[code])
                    k = code % 19683
                if k not in then or s > then[k][0]:
                    then[k] = (s, (path, letters))
        states = then
    _, path = max(((s + (0.0 if k and k % 27 == 0 else float(log4[k * 27])), path) for k, (s, path) in states.items()), key=lambda x: x[0])
    read = []
    while path:
        path, letters = path
        read.append(letters)
    return "".join(reversed(read))


def words_of(chunk: str, log4: np.ndarray) -> set[str]:
    """Words of a chunk (or of letters set apart by blanks), as written and as restored."""
    plain = chunk.lower()
    if not plain.isascii():
        plain = plain.translate(ACCENTED)
    words = set(WORD.findall(plain))
    spaced = " " in plain
    if spaced:
        for span in SPACED.findall(plain):
            words.update(w for w in decode(span, log4).split(EDGE) if w)
        return words
    if not NEEDS.search(plain):
        return words
    words.update(decode(span, log4) for span in SPAN.findall(plain) if NEEDS.search(span))
    return words


def features_of(words) -> set[str]:
    """Each word, and beginnings of it."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w)
            out.update(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)
    return out


def spaced_out(chunks: list[str]) -> list[str]:
    """Runs of four or more single characters or of three with two letters, each perhaps with marks, joined by blanks."""
    # a longer chunk is of one letter only if a mark is at one of its ends
    single = np.flatnonzero([len(c) == 1 or (not (c[0].isalnum() and c[-1].isalnum()) and ONE_LETTER.fullmatch(c) is not None) for c in chunks])
    if len(single) < 3:
        return []
    cuts = np.flatnonzero(np.diff(single) > 1) + 1
    runs = [chunks[r[0] : r[-1] + 1] for r in np.split(single, cuts) if len(r) >= 3]
    return [" ".join(r) for r in runs if len(set(r)) > 2 and (len(r) >= 4 or sum(any(x.isalpha() for x in c) for c in r) >= 2)]


# ---------------------------------------------------------------- a first look


def beginnings(features) -> np.ndarray:
    """For every 4-gram (base 27) whether a word that shows one of the features may begin with it; words of three letters end in 0."""
    out = np.zeros(27**4, bool)
    for f in features:
        code = 0
        for c in f.rstrip("*").ljust(4, EDGE)[:4]:
            code = code * 27 + ord(c) - 96
        out[code] = True
    return out


class Chunks:
    """The chunks of texts, as bytes, and which of them have to be read.

    ``telling`` is true for each that may have something to restore or show a
    feature: those with other letters than plain ones and ones with a mark, with
    several words, a run of three letters, a letter beside a sign, or a word with
    such a beginning.  ``spaced`` has the texts with three chunks in a row that
    may be single characters.
    """

    def __init__(self, texts: list[str], begins: np.ndarray):
        coded = [t.encode() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in coded], dtype=np.int64)
        data = np.frombuffer(bytearray(b" ".join([*coded, b""])), np.uint8)
        for m in WIDE_BLANK.finditer(data):
            data[m.start() : m.end()] = 32
        self.data = data
        inside = np.concatenate([[False], ~BLANK[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.stops = edges[::2], edges[1::2]
        self.texts = np.searchsorted(ends, self.starts, "right")
        if not len(self.starts):
            self.telling, self.spaced = np.zeros(0, bool), set()
            return
        symbols = SYMBOL[data]
        starts = self.starts
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[ONE_AFTER_C3[data[after]] > 0]
        if len(after):  # such a letter is its second byte
            symbols[after] = ONE_AFTER_C3[data[after]]
            starts = starts - np.searchsorted(after, starts, "left")
            data, symbols = np.delete(data, after - 1), np.delete(symbols, after - 1)
        letter, sign = symbols > 0, SIGN[data]
        flags = (data >= 128) & ~letter
        flags[:-1] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        flags[:-2] |= letter[:-2] & (symbols[:-2] == symbols[1:-1]) & (symbols[:-2] == symbols[2:])
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        at = np.flatnonzero(first)
        s = np.concatenate([symbols, np.zeros(3, np.uint8)]).astype(np.int32)
        flags[at[begins[((s[at] * 27 + s[at + 1]) * 27 + s[at + 2]) * 27 + s[at + 3]]]] = True
        self.telling = np.logical_or.reduceat(flags, starts) | (np.add.reduceat(first, starts, dtype=np.int32) > 1)
        lone = np.add.reduceat(letter | DIGIT[data], starts, dtype=np.int32) <= 1
        three = lone[:-2] & lone[1:-1] & lone[2:] & (self.texts[:-2] == self.texts[2:])
        self.spaced = set(self.texts[:-2][three].tolist())

    def told(self, n: int) -> list[set[str]]:
        """The telling chunks of each of ``n`` texts."""
        out = [set() for _ in range(n)]
        raw, some = self.data.tobytes(), self.telling
        for t, a, b in zip(self.texts[some].tolist(), self.starts[some].tolist(), self.stops[some].tolist()):
            out[t].add(raw[a:b].decode())
        return out


# ---------------------------------------------------------------- learning


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(text, toxic) of a bounded sample, one row for each distinct text."""
    known = narrow(labels, id="doc_id", toxic="toxic").where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & (fold_of(F.col("id")) != 0))
    some = bounded_sample(known.groupBy("id").agg(F.max("toxic").alias("toxic")), sample_docs)
    # at most sample_docs rows of two numbers
    texts = narrow(docs, id="doc_id", text="text").join(F.broadcast(some), "id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return texts.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    spark = docs.sparkSession
    log4 = log_model(corpus_grams(docs))
    held = spark.sparkContext.broadcast(log4)
    sample = labelled_sample(docs, labels, sample_docs)

    @sparing
    def count(batches):
        positive, negative = Counter(), Counter()
        for batch in batches:
            texts = (t for _, some in text_lists(batch.column("text"), GROUP) for t in some)
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                chunks = text.split()
                words = set().union(*(words_of(c, held.value) for c in [*set(chunks), *spaced_out(chunks)])) if chunks else set()
                (positive if toxic else negative).update(features_of(words))
        names = [f for f, c in positive.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([positive[f] for f in names], pa.int64()), pa.array([negative[f] for f in names], pa.int64())],
            names=["feature", "positive", "negative"],
        )
        # what only the negative documents of this task have
        names = [f for f in negative if f not in positive]
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([negative[f] for f in part], pa.int64())], names=["feature", "positive", "negative"])

    counted = sample.select("text", "toxic").mapInArrow(count, "feature string, positive long, negative long")
    sums = counted.groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    # counted without the features, which would be worked out once more for two numbers
    positives = F.count_if(F.col("toxic").cast("boolean"))
    tp, tn = sample.agg(positives, F.count(F.lit(1)) - positives).first()
    if not tp or not tn:
        return Model(log4, {}, -10.0)
    share = tp / (tp + tn)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    g2 = 2 * (p * F.log(p / ((p + n) * share)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0))
    best = sums.where(f"p >= 3 and p * {tn} > 3 * n * {tp}").withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    chosen = best.orderBy(F.desc("g2"), "feature").limit(FEATURES).collect()
    names = [r["feature"] for r in chosen]
    shared = spark.sparkContext.broadcast(Model(log4, dict.fromkeys(names, 0.0), 0.0))
    index = {f: i for i, f in enumerate(names)}

    @sparing
    def hits(batches):
        reader = Reader(shared.value)
        for batch in batches:
            found = [h for _, some in text_lists(batch.column("text"), GROUP) for h in reader.hits(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[index[f] for f in c] for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())],
                names=["features", "counts", "toxic"],
            )

    # a row for each sampled text: at most sample_docs, of at most FEATURES numbers
    rows = sample.select("text", "toxic").mapInArrow(hits, "features array<int>, counts array<int>, toxic int").collect()
    weights, bias = _logistic([r["features"] for r in rows], [r["counts"] for r in rows], np.array([float(bool(r["toxic"])) for r in rows]), len(names))
    return Model(log4, dict(zip(names, weights.tolist())), bias)


def _logistic(features: list[list[int]], counts: list[list[int]], y: np.ndarray, n: int, ridge: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression over sparse rows, by Adam on the whole sample."""
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    column = np.fromiter(chain.from_iterable(features), np.int64, len(row))
    value = np.sqrt(np.fromiter(chain.from_iterable(counts), np.float64, len(row)))
    beta, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    beta[n] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for step in range(1, steps + 1):
        z = beta[n] + np.bincount(row, value * beta[column], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.append(np.bincount(column, value * error[row], n) + ridge * beta[:n], error.sum())
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient * gradient - second)
        beta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return beta[:n], float(beta[n])


class Reader:
    """What texts contain of a model's features."""

    def __init__(self, model: Model):
        self.model = model
        self.begins = beginnings(model.weights)
        self.memo: dict[str, tuple[str, ...]] = {}  # chunk -> its words that show a feature
        self.shown: dict[str, list[str]] = {}  # such a word -> the features

    def _read(self, chunk: str) -> tuple[str, ...]:
        out = []
        for w in words_of(chunk, self.model.log4):
            shown = self.shown.get(w)
            if shown is None:
                shown = [f for f in features_of((w,)) if f in self.model.weights]
                if shown:
                    self.shown[w] = shown
            if shown:
                out.append(w)
        return tuple(out)

    def hits(self, texts: list[str]) -> list[Counter]:
        """For each text, its features and how many different words show them."""
        chunks = Chunks(texts, self.begins)
        lists = chunks.told(len(texts))
        seen = set(chain.from_iterable(lists))
        if len(self.memo) > MEMO:
            self.memo, self.shown = {}, {}
        fresh = {c: self._read(c) for c in seen - self.memo.keys()}
        if len(fresh) <= MEMO and all(len(c) <= 64 for c in fresh):
            self.memo.update(fresh)
            get = self.memo.__getitem__
        else:  # what must not stay in the memo is known for these texts only
            known = {c: self.memo[c] for c in seen & self.memo.keys()} | fresh
            self.memo.update(list((c, f) for c, f in fresh.items() if len(c) <= 64)[:MEMO])
            get = known.__getitem__
        out = []
        for i, some in enumerate(lists):
            words = set(chain.from_iterable(set(map(get, some))))
            for run in spaced_out(texts[i].split()) if i in chunks.spaced else ():
                words.update(self._read(run))
            out.append(Counter(f for w in words for f in self.shown[w]))
        return out

    def logits(self, texts: list[str]) -> list[tuple[float, int]]:
        """The regression's value and the number of features of each text."""
        weights = self.model.weights
        return [(self.model.bias + sum(weights[f] * math.sqrt(n) for f, n in c.items()), len(c)) for c in self.hits(texts)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, n_hits of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, id=id_col, text=text_col).select("id", "text", F.coalesce(fold_of(F.col("id")) == 0, F.lit(False)).alias("held_out"))

    @sparing
    def run(batches):
        reader = Reader(held.value)
        m = held.value
        for batch in batches:
            found = [h for _, some in text_lists(batch.column("text"), GROUP) for h in reader.logits(some)]
            z, hits = np.array([f[0] for f in found], float), np.array([f[1] for f in found], np.int64)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if not m.weights:
                s = np.zeros(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits)],
                names=["id", "held_out", "score", "predicted", "n_hits"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, n_hits long").withColumnRenamed("id", id_col)


def clean_parts(batch: pa.RecordBatch, at: int, reader: Reader):
    """The rows of ``batch`` whose texts (column ``at``) aren't predicted toxic, in parts of about GROUP bytes of text.

    Small parts keep small what the worker and the JVM that reads them hold at once.
    """
    for start, some in text_lists(batch.column(at), GROUP):
        clean = [not reader.model.weights or x < 0 for x, _ in reader.logits(some)]
        yield batch.slice(start, len(some)).filter(pa.array(clean, pa.bool_()))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @sparing
    def run(batches):
        reader = Reader(held.value)
        for batch in batches:
            yield from clean_parts(batch, at, reader)

    return docs.mapInArrow(run, docs.schema)
