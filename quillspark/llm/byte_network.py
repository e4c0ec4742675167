"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready, text_bytes
from quillspark.llm.labelled import fold, training_rows

#: The network is fitted on so many labelled rows at most.
MOST_LABELLED = 3_000
#: Chunks of CHUNK bytes begin every CHUNK - OVERLAP bytes, up to the end of the text.
CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE, DEPTH, FILTERS = 8, 2, 8, 16
#: Chunks that are worked on at once.
_BLOCK = 256


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, one a row and padded with zeros, and each chunk's text. Whole texts are covered;
    an empty text is one chunk of zeros."""
    step = CHUNK - OVERLAP
    counts = [max(1, -(-(len(t) - OVERLAP) // step)) for t in texts]
    padded = b"".join(t.ljust(n * step + OVERLAP, b"\0") for t, n in zip(texts, counts))
    data = np.frombuffer(padded, np.uint8)
    sizes = np.array(counts) * step + OVERLAP
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(sizes) - sizes, counts) + place * step
    return data[begin[:, None] + np.arange(CHUNK)], text


class Network:
    """Bytes become DEPTH numbers each; FILTERS filters over WIDTH bytes slide over a chunk; the greatest of each
    filter's answers is the chunk's; the mean and the greatest over a text's chunks make its score."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bytes = (0.1 * rng.standard_normal((256, DEPTH))).astype(np.float32)
        kinds = [range(65, 91), range(97, 123), range(48, 58), [32], [10], [44, 46], range(128, 256),
                 [b for b in range(33, 127) if not chr(b).isalnum() and b not in (44, 46)]]
        for d, kind in enumerate(kinds):
            self.bytes[list(kind), d] += 1
        self.filters = (rng.standard_normal((WIDTH * DEPTH, FILTERS)) / np.sqrt(WIDTH * DEPTH)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (0.1 * rng.standard_normal(2 * FILTERS)).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.out, self.offset]

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        dense = self.bytes[chunks].reshape(len(chunks), -1)
        views = np.lib.stride_tricks.sliding_window_view(dense, WIDTH * DEPTH, axis=1)
        return views[:, ::STRIDE * DEPTH]

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Each filter's greatest answer in each chunk (0 at least), and where it is found."""
        best, at = [], []
        for i in range(0, len(chunks), _BLOCK):
            answers = self._windows(chunks[i:i + _BLOCK]) @ self.filters
            best.append(answers.max(1))
            if places:
                at.append(answers.argmax(1))
        values = np.maximum(np.concatenate(best) + self.bias, 0)
        return (values, np.concatenate(at)) if places else values

    def combined(self, values: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
        """Mean and maximum over each text's chunks."""
        first = np.searchsorted(text, np.arange(count))
        size = np.bincount(text, minlength=count)[:, None]
        return np.hstack([np.add.reduceat(values, first, axis=0) / size, np.maximum.reduceat(values, first, axis=0)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        chunks, text = chunks_of(texts)
        logits = self.combined(self.pooled(chunks), text, len(texts)) @ self.out + self.offset[0]
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the weighted logistic loss; behind a maximum only the place where it was found has a share."""
        chunks, text = chunks_of(texts)
        values, places = self.pooled(chunks, places=True)
        both = self.combined(values, text, len(texts))
        p = 1 / (1 + np.exp(-np.clip(both @ self.out + self.offset[0], -30, 30)))
        error = ((p - labels) * weights).astype(np.float32)
        d_out, d_offset = both.T @ error, np.array([error.sum()], np.float32)
        size = np.bincount(text, minlength=len(texts)).astype(np.float32)
        back = (error / size)[text, None] * self.out[:FILTERS]
        top = both[text, FILTERS:] == values
        back += np.where(top, error[text, None] * self.out[FILTERS:], 0)
        back *= values > 0
        d_filters, d_bytes = np.zeros_like(self.filters), np.zeros_like(self.bytes)
        row = np.arange(len(chunks))[:, None]
        for f in range(FILTERS):
            own = np.flatnonzero(back[:, f])
            if not len(own):
                continue
            where = places[own, f][:, None] * STRIDE + np.arange(WIDTH)
            codes = chunks[row[own], where]
            share = back[own, f]
            d_filters[:, f] = share @ self.bytes[codes].reshape(len(own), -1)
            spread = share[:, None, None] * self.filters[:, f].reshape(WIDTH, DEPTH)
            for d in range(DEPTH):
                d_bytes[:, d] += np.bincount(codes.ravel(), spread[:, :, d].ravel(), 256).astype(np.float32)
        return [d_bytes, d_filters, back.sum(0), d_out, d_offset]


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, epochs: int = 8, batch: int = 32,
        rate: float = 0.01, seed: int = 0) -> Network:
    """A network fitted by Adam. ``share``: the share of label 1 among all rows, which the sample's rows are
    weighted to; with one label only, or no rows, the network stays at that share."""
    net = Network(seed)
    ones = float(labels.sum())
    share = (ones + 0.5) / (len(labels) + 1) if share is None else share
    if not 0 < ones < len(labels):
        net.out[:] = 0
        net.offset[0] = np.log(share / (1 - share))
        return net
    own = ones / len(labels)
    weights = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            step += 1
            now = rate * (1 - step / (total + 1))
            grads = net.gradients([texts[j] for j in chosen], labels[chosen], weights[chosen] / len(chosen))
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, folds: int = 5,
           held_out: int = 0, key: str = "doc_id", text: str = "text") -> Network:
    """A network from at most ``most`` labelled rows outside the held-out fold (see training_rows)."""
    sample = training_rows(docs, labels, label, most, folds, held_out, key, text).toArrow()
    order = np.argsort(np.array(sample["_key"].to_pylist(), dtype=object), kind="stable")
    texts = text_bytes(sample["_text"].combine_chunks()) if len(order) else []
    marks = np.array(sample["label"].to_pylist(), np.float64)[order]
    known = labels.filter(F.col(label).isin(0, 1) & (fold(key, folds) != held_out))
    ones, every = known.agg(F.sum(label), F.count(label)).first()
    return fit([texts[i] for i in order], marks, ((ones or 0) + 0.5) / (every + 1))


def _score(net: Network, at: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            scores = [net.scores(texts[cut]) for cut in pieces([len(t) for t in texts], 500_000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))],
                                             names=[*batch.schema.names, "score"])
    return emit


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1, the network's probability of label 1 for the whole text.

    NULL and empty texts get the score of an empty chunk. All rows and columns are kept; a column called score is
    replaced. Equal texts get equal scores. Nothing is shuffled. An empty table gives an empty one.
    """
    python_ready(docs.sparkSession)
    rows = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_score(net, rows.columns.index(text)), f"{kinds}, score double")
