"""Quality of whole texts by a byte-level convolutional network in numpy.

Filters slide over every byte of a text; their activations are max-pooled in chunks of ``2 * HALF`` bytes that overlap by half
and cover the whole document.  Mean and maximum over the chunks go into one logistic unit.  A filter is a table of one weight
per place and input symbol, so a convolution is a sum of look-ups.  The input symbol of a byte also says whether the text repeats
there what it wrote a few bytes before, which no filter of this width could see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import bounded_sample, fold, utf8, with_scores

WIDTH, FILTERS, HALF = 5, 16, 256
#: Bytes, and the same bytes where they repeat: equal to the byte at one of the lags before, for RUN bytes from there.
SYMBOLS, LAGS, RUN = 512, range(3, 22), 8
#: Bound of the labelled sample that the driver fits on: rows and characters.
SAMPLE_ROWS, SAMPLE_CHARS = 2400, 8_000_000
#: Bytes of text whose activations are held at once.
BLOCK = 1 << 18


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x SYMBOLS x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        """Random filters over a few properties that bytes share, so that like bytes begin alike."""
        random = np.random.default_rng(seed)
        codes = np.arange(SYMBOLS) % 256
        kinds = np.stack([
            (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90), (codes >= 48) & (codes <= 57), codes == 32,
            (codes == 10) | (codes == 13) | (codes == 9), (codes > 32) & (codes < 48), (codes > 57) & (codes < 65),
            (codes > 90) & (codes < 97), (codes > 122) & (codes < 128), codes >= 128, np.arange(SYMBOLS) >= 256], 1).astype(np.float32)
        shared = kinds @ random.normal(0, 0.5, (kinds.shape[1], WIDTH * FILTERS)).astype(np.float32)
        tables = shared.reshape(SYMBOLS, WIDTH, FILTERS).transpose(1, 0, 2) + random.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS))
        tables[:, 0, :] = 0
        return cls(np.ascontiguousarray(tables, np.float32), np.zeros(FILTERS, np.float32),
                   random.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def convolve(self, padded: np.ndarray) -> np.ndarray:
        """Activation at every byte that has WIDTH - 1 bytes after it."""
        n = len(padded) - WIDTH + 1
        out = self.tables[0].take(padded[:n], 0)
        for k in range(1, WIDTH):
            out += self.tables[k].take(padded[k:n + k], 0)
        return out


def symbols(padded: np.ndarray) -> np.ndarray:
    """Input symbols of a stretch of bytes; zeros between texts never repeat."""
    repeats = np.zeros(len(padded), bool)
    for lag in LAGS:
        same = padded[lag:] == padded[:-lag]
        same &= padded[lag:] != 0
        for step in (1, 2, 4):  # runs of two, four and RUN equal bytes
            same[:-step] &= same[step:]
            same[len(same) - step:] = False
        repeats[lag:] |= same
    return padded + (repeats.astype(np.uint16) << 8)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each filled with zeros to whole halves, and the first half of each.

    A zero byte has no weight in any filter; an empty text is one half of zeros.  Enough zeros stand between two texts that no repeat
    reaches from one into the other.
    """
    halves = np.array([-(-(len(t) + max(LAGS)) // HALF) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(halves)])
    padded = np.zeros(int(first[-1]) * HALF + WIDTH - 1 + max(LAGS), np.uint8)
    for begin, text in zip(first * HALF, texts):
        padded[begin:begin + len(text)] = np.frombuffer(text, np.uint8)
    return symbols(padded)[:len(padded) - max(LAGS)], first


def pool(network: Network, padded: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum (and its place) of each filter in each half, before bias and rectifier; blocks bound the memory.

    The last places of a text's last half are left out: filters there would reach into the next text.
    """
    ends = first[1:] - 1
    halves = (len(padded) - WIDTH + 1) // HALF
    best = np.empty((halves, FILTERS), np.float32)
    where = np.empty((halves, FILTERS), np.int64) if places else None
    step = BLOCK // HALF
    for a in range(0, halves, step):
        b = min(halves, a + step)
        found = network.convolve(padded[a * HALF:b * HALF + WIDTH - 1]).reshape(b - a, HALF, FILTERS)
        found[ends[(ends >= a) & (ends < b)] - a, HALF - WIDTH + 1:] = -np.inf
        found.max(1, out=best[a:b])
        if where is not None:
            where[a:b] = found.argmax(1) + (np.arange(a, b) * HALF)[:, None]
    return best, where


def chunks(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of the overlapping chunks, the half each comes from, and the first chunk of each text."""
    halves = np.diff(first)
    counts = np.maximum(halves - 1, 1)
    begins = np.concatenate([[0], np.cumsum(counts)])
    left = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(first[:-1], counts)
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, counts))
    later = best[right] > best[left]
    return np.where(later, best[right], best[left]), np.where(later, right[:, None], left[:, None]), begins


def features(network: Network, texts: list[bytes]) -> np.ndarray:
    padded, first = layout(texts)
    best, _ = pool(network, padded, first)
    active, _, begins = chunks(best, first)
    active = np.maximum(active + network.bias, 0)
    mean = np.add.reduceat(active, begins[:-1], 0) / np.diff(begins)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(active, begins[:-1], 0)], 1)


def predict(network: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if not texts:
        return np.zeros(0)
    logit = features(network, texts).astype(np.float64) @ network.dense + network.offset
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(network: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; through a maximum only the place of the maximum is moved."""
    padded, first = layout(texts)
    best, where = pool(network, padded, first, places=True)
    active, source, begins = chunks(best, first)
    active = np.maximum(active + network.bias, 0)
    counts = np.diff(begins)
    mean = np.add.reduceat(active, begins[:-1], 0) / counts[:, None]
    top = np.maximum.reduceat(active, begins[:-1], 0)
    joined = np.concatenate([mean, top], 1)
    error = (1 / (1 + np.exp(-np.clip(joined @ network.dense + network.offset, -30, 30))) - labels) / len(texts)
    from_mean = np.repeat(error / counts, counts)[:, None] * network.dense[:FILTERS]
    owner = np.repeat(np.arange(len(texts)), counts)
    is_top = active == top[owner]
    from_top = is_top * (error[owner][:, None] * network.dense[FILTERS:]) / np.add.reduceat(is_top, begins[:-1], 0)[owner]
    flow = ((from_mean + from_top) * (active > 0)).astype(np.float32)
    tables = np.zeros_like(network.tables)
    chunk, f = np.nonzero(flow)
    amount, place = flow[chunk, f], where[source[chunk, f], f]
    for k in range(WIDTH):
        np.add.at(tables[k], (padded[place + k], f), amount)
    tables[:, 0, :] = 0
    return [tables, flow.sum(0), joined.T @ error, np.array([error.sum()])]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam over shuffled batches; the rate falls to a tenth.  Labels of one kind give that kind's constant."""
    network = Network.fresh(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    network.offset[:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        network.dense[:] = 0
        return network
    random = np.random.default_rng(seed)
    weights = [network.tables, network.bias, network.dense, network.offset]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps = epochs * -(-len(texts) // batch)
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            step += 1
            pace = rate * (1 - 0.9 * step / steps)
            for w, g, m, v in zip(weights, gradients(network, [texts[i] for i in rows], labels[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return network


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    sample = bounded_sample(docs, known.where(fold() != held_out), SAMPLE_ROWS, SAMPLE_CHARS)
    return train([text.encode() for text, _ in sample], np.array([label for _, label in sample], np.float64))


def judged(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """Every row with all its columns, ``_score`` and ``_predicted``, by the whole text alone.

    Null and empty texts are one empty chunk and get its score; repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return with_scores(docs, lambda texts: predict(shared.value, utf8(texts)), threshold)


def score(docs: DataFrame, network: Network, threshold: float = 0.3, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null id is not held out.  Other columns are not read."""
    return judged(docs.select("doc_id", "text"), network, threshold).select(
        "doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"))
