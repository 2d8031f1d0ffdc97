"""Language identification by a byte convolutional network, trained and run in numpy.

Filters of widths 2, 3 and 4 run over the bytes of a window of fixed length;
each filter's largest response in the window goes to a softmax layer.  As bytes
are categories, a filter is a table (position in the filter, byte) -> weight
for every filter, and a convolution is a sum of looked-up rows.  For running, two
neighbouring positions are joined to one table over byte pairs.

Every window of every whole text is scored, in batches that Spark's tasks form;
a text's probabilities are the mean over its windows, weighted by their letters.

Training uses at most ``SAMPLE_DOCS`` labelled documents of the folds that may
be learnt from, ``WINDOWS_PER_DOC`` windows each (the bound of the fit); they
are picked by a hash of the id, so the choice doesn't depend on partitioning.
Whole texts never leave the tasks that read them.

Cases: null text and text without a letter get ``und`` and score 0; with no
labelled row to learn from every text gets ``und``; null ids are predicted like
others but never learnt from; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.common import bounded_sample, byte_sized, fold_of, narrow, sparing, utf8_of

WIDTHS = (2, 3, 4)  # joined() and predict() are written for these
FILTERS = 8
WINDOW = 256
SAMPLE_DOCS = 8_000
WINDOWS_PER_DOC = 2
EPOCHS = 4
BATCH = 256


def _folding() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table


FOLDING = _folding()


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes: A-Z, and the capitals of Latin-1 as UTF-8 has them."""
    out = FOLDING[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 32
    return out


def windows_of(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows of bytes, blanks after a text's end) and the text each belongs to."""
    lengths = np.diff(bounds)
    per = np.maximum(1, -(-lengths // window))
    of = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[:-1][of] + number * window
    held = np.minimum(window, bounds[1:][of] - start)
    padded = np.concatenate([data, np.full(window, 32, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, window)[start] if len(of) else np.zeros((0, window), np.uint8)
    short = held < window
    if short.any():
        rows = np.array(rows)
        part = rows[short]
        part[np.arange(window) >= held[short][:, None]] = 32
        rows[short] = part
    return rows, of


class ByteConvolution:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = x.shape
        columns = np.ascontiguousarray(x.T)
        best = np.full((len(WIDTHS), n, FILTERS), -np.inf, np.float32)
        at = np.zeros((len(WIDTHS), n, FILTERS), np.int32)
        for k, w in enumerate(WIDTHS):
            for p in range(length - w + 1):
                r = self.filters[k][0][columns[p]]
                for j in range(1, w):
                    r += self.filters[k][j][columns[p + j]]
                more = r > best[k]
                best[k][more] = r[more]
                at[k][more] = p
        return best, at

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6, rate: float = 0.02) -> None:
        rng = np.random.default_rng(seed)
        counts = np.bincount(y, minlength=len(self.languages))
        weight = (len(y) / np.maximum(counts, 1) / len(self.languages)).astype(np.float32)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                some = order[k : k + BATCH]
                grads = self._gradients(x[some], y[some], weight)
                step += 1
                lr = rate * (0.5 ** epoch)
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def _gradients(self, x, y, weight):
        n = len(y)
        best, at = self._pooled(x)
        raw = best.transpose(1, 0, 2).reshape(n, -1) + self.bias
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p *= weight[y][:, None] / n
        g_hidden = (p @ self.out.T) * (raw > 0)
        g_filters = []
        line = np.arange(n)[:, None]
        f = np.arange(FILTERS)[None, :]
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(self.filters[k])
            own = g_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[line, at[k] + j], np.broadcast_to(f, own.shape)), own)
            g_filters.append(g)
        return [*g_filters, g_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters over byte pairs (first * 256 + second), all widths side by side.

        The first table has what every width adds for its first two bytes, the
        second what widths 3 and 4 add for the pair that follows.
        """
        two, three, four = self.filters
        start = [t[0][:, None, :] + t[1][None, :, :] for t in (two, three, four)]
        after = [np.broadcast_to(three[2][:, None, :], start[0].shape), four[2][:, None, :] + four[3][None, :, :]]
        return tuple(np.ascontiguousarray(np.concatenate(t, axis=2).reshape(1 << 16, -1)) for t in (start, after))

    def predict(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities of each language for each window."""
        start, after = tables
        probabilities = np.empty((len(x), len(self.languages)), np.float32)
        for k in range(0, len(x), 1024):
            part = x[k : k + 1024]
            columns = np.ascontiguousarray(part.T).astype(np.intp)
            pairs = columns[:-1] * 256 + columns[1:]
            n, length = part.shape
            best = np.full((n, 3 * FILTERS), -np.inf, np.float32)
            r, more = np.empty((n, 3 * FILTERS), np.float32), np.empty((n, 2 * FILTERS), np.float32)
            for p in range(length - 3):
                np.take(start, pairs[p], axis=0, out=r, mode="clip")
                np.take(after, pairs[p + 2], axis=0, out=more, mode="clip")
                r[:, FILTERS:] += more
                np.maximum(best, r, out=best)
            for p in (length - 3, length - 2):  # the narrower filters' last places
                r = start[pairs[p]]
                if p == length - 3:
                    r[:, FILTERS : 2 * FILTERS] += self.filters[1][2][columns[p + 2]]
                upto = 2 * FILTERS if p == length - 3 else FILTERS
                np.maximum(best[:, :upto], r[:, :upto], out=best[:, :upto])
            hidden = np.maximum(best + self.bias, 0)
            probabilities[k : k + 1024] = _softmax(hidden @ self.out + self.out_bias)
        return probabilities


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of a bounded sample of labelled documents."""
    rows = narrow(docs, id="doc_id", text="text", lang="lang")
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("id")) != 0))
    length = F.length("text")
    cut = [
        F.expr(f"substring(text, cast(1 + pmod(xxhash64(id, {k}), greatest(1, length(text) - {WINDOW})) as int), {WINDOW})")
        for k in range(WINDOWS_PER_DOC)
    ]
    # texts are cut before rows are put in order, so what tasks hold on to is bounded in bytes too
    windows = rows.where(length > 0).select("id", "lang", F.array(*cut).alias("cuts"))
    held = bounded_sample(windows, sample_docs).select("lang", "cuts").collect()
    x, y = [], []
    for r in held:
        for c in r["cuts"]:
            raw = np.frombuffer(c.encode()[:WINDOW], np.uint8)
            row = np.full(WINDOW, 32, np.uint8)
            row[: len(raw)] = folded(raw)
            x.append(row)
            y.append(r["lang"])
    return (np.stack(x) if x else np.zeros((0, WINDOW), np.uint8)), y


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteConvolution | None:
    x, y = training_windows(docs, sample_docs)
    if not y:
        return None
    languages = sorted(set(y))
    network = ByteConvolution(languages)
    index = {lang: i for i, lang in enumerate(languages)}
    network.fit(x, np.array([index[lang] for lang in y]))
    return network


def identify(docs: DataFrame, network: ByteConvolution | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, n_windows for every whole text."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(network)
    rows = narrow(docs, id=id_col, text=text_col).select("id", "text", F.coalesce(fold_of(F.col("id")) == 0, F.lit(False)).alias("held_out"))

    @sparing
    def run(batches):
        net = held.value
        tables = net.joined() if net else None
        for batch in batches:
            text = batch.column("text")
            for start, n in byte_sized(text, 1 << 21):
                part = text.slice(start, n)
                data, bounds = utf8_of(part)
                data = folded(data)
                letters = (data >= 97) & (data <= 122)
                letter_count = np.concatenate([[0], np.cumsum(letters | (data >= 0x80))])
                some = letter_count[bounds[1:]] > letter_count[bounds[:-1]]
                plain = np.concatenate([[0], np.cumsum(letters)])
                for i in np.flatnonzero(some & (plain[bounds[1:]] == plain[bounds[:-1]])):
                    some[i] = any(c.isalpha() for c in part[int(i)].as_py())
                names, scores = np.full(n, "und", object), np.zeros(n)
                x, of = windows_of(data, bounds)
                if net and n:
                    weight = ((x >= 97) & (x <= 122) | (x >= 0x80)).sum(1) + 1e-3
                    p = net.predict(x, tables) * weight[:, None]
                    total = np.zeros((n, p.shape[1]))
                    np.add.at(total, of, p)
                    total /= np.bincount(of, weight, n)[:, None]
                    best = total.argmax(1)
                    names[some] = np.array(net.languages, object)[best[some]]
                    scores[some] = np.clip(total[np.arange(n), best][some], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, n), batch.column("held_out").slice(start, n), pa.array(names, pa.string()), pa.array(scores), pa.array(np.bincount(of, minlength=n), pa.int64())],
                    names=["id", "held_out", "lang_pred", "score", "n_windows"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, n_windows long").withColumnRenamed("id", id_col)
