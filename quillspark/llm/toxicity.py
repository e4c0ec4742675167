"""Toxicity: a linear classifier whose scores may not change when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready, span_hashes, text_bytes
from quillspark.llm.labelled import fold, training_rows

#: The model is fitted on so many labelled rows at most.
MOST_LABELLED = 4_000
FEATURE_BITS = 20
PREFIXES = (4, 5, 6)
#: Neutral mentions of groups; a parameter of fitted().
IDENTITY_TERMS = ("women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants",
                  "refugees", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "african",
                  "european", "disabled", "deaf", "blind", "elderly", "teenagers")
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs, in order and each once: the words of each text and their beginnings.

    A word is a run of letters a to z (A-Z lower-cased) and bytes from 128 on, so it is found whatever
    punctuation it carries. Features are hashes of FEATURE_BITS bits.
    """
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(limits, starts, "right")
    found = [_feature(data, starts, ends, 0)]
    owners = [text]
    for n in PREFIXES:
        long = ends - starts >= n
        found.append(_feature(data, starts[long], starts[long] + n, n))
        owners.append(text[long])
    both = np.unique((np.concatenate(owners).astype(np.int64) << FEATURE_BITS) | np.concatenate(found))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def _feature(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    salted = span_hashes(data, starts, ends) + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((salted * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _mention(terms: Sequence[bytes]) -> re.Pattern:
    """Any of the terms as a whole word of a lower-cased text."""
    return re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(map(re.escape, terms)) + rb")(?![a-z\x80-\xff])")


def counterfactuals(text: bytes, terms: Sequence[str]) -> list[tuple[bytes, bytes]]:
    """Pairs of texts that should score alike. Each identity term that the text holds as a whole word is swapped for
    another one, wherever it stands; a text without any gets one put in, and that one swapped. Which other term it is,
    follows from the text."""
    words, text = [t.encode().lower() for t in terms], text.lower()
    if not words:
        return []
    turn = crc32(text)
    other = {w: words[(i + 1 + turn % max(len(words) - 1, 1)) % len(words)] for i, w in enumerate(words)}
    present = sorted(set(_mention(words).findall(text)))
    if present:
        return [(text, _mention([w]).sub(lambda _: other[w], text)) for w in present]
    one = words[turn % len(words)]
    put = text + b" " + one
    return [(text, put), (put, text + b" " + other[one])]


def differences(text: bytes, terms: Sequence[str]) -> list[np.ndarray]:
    """For each pair, what the second text's features have more (f + 1) and less (-f - 1) than the first's."""
    out = []
    for one, two in counterfactuals(text, terms):
        before, after = features_of([one])[1], features_of([two])[1]
        out.append(np.concatenate([np.setdiff1d(after, before) + 1, -1 - np.setdiff1d(before, after)]))
    return out


class _Rows:
    """Sparse rows with the values 1, or the signs that are given."""

    def __init__(self, rows: Sequence[np.ndarray], signs: Sequence[np.ndarray] | None = None):
        self.columns = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32)
        self.signs = None if signs is None else np.concatenate([*signs, np.zeros(0)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.count = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        own = weights[self.columns]
        return np.bincount(self.row, own if self.signs is None else own * self.signs, self.count)

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        own = values[self.row]
        return np.bincount(self.columns, own if self.signs is None else own * self.signs, width)


def loss_and_slopes(weights: np.ndarray, offset: float, x: _Rows, labels: np.ndarray, pairs: _Rows,
                    fairness: float) -> tuple[float, np.ndarray, float]:
    """The mean logistic loss, plus ``fairness`` times the squared changes of the log-odds over the pairs, for each
    row; with its slopes by weight and offset."""
    logits, change, n = x.times(weights) + offset, pairs.times(weights), max(x.count, 1)
    p = 1 / (1 + np.exp(-logits))
    loss = np.mean(np.logaddexp(0, logits) - labels * logits) + fairness * np.sum(change ** 2) / n
    slopes = x.back((p - labels) / n, len(weights)) + pairs.back(2 * fairness * change / n, len(weights))
    return float(loss), slopes, float(np.mean(p - labels))


def rescaled(logits: np.ndarray, labels: np.ndarray, share: float, steps: int = 25,
             ridge: float = 1e-3) -> tuple[float, float]:
    """(scale, offset) that make a chance of the logits again, for rows of which ``share`` have label 1; the
    penalties of fit() had drawn the weights towards 0. Newton's method on two numbers."""
    own = labels.mean()
    weight = np.where(labels == 1, share / own, (1 - share) / (1 - own)) / len(labels)
    both = np.stack([logits, np.ones_like(logits)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(both @ at, -30, 30)))
        slope = both.T @ (weight * (p - labels)) + ridge * np.array([at[0] - 1, 0.0])
        curve = (both * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ both + ridge * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: Sequence[np.ndarray], steps: int = 120,
        sparse: float = 6e-4, fairness: float = 1.0, share: float | None = None) -> tuple[np.ndarray, float]:
    """Weights by feature and the offset, for rows of which ``share`` have label 1 (the sample's, if None).

    Minimises loss_and_slopes, plus ``sparse`` times the weights' absolute values, by accelerated proximal gradient
    steps. pairs: the ``differences`` of the rows' texts. One label only, or no row, gives no weights.
    """
    width = 1 << FEATURE_BITS
    own_share = (labels.sum() + 0.5) / (len(labels) + 1)
    share = own_share if share is None else share
    offset = float(np.log(own_share / (1 - own_share)))
    if not 0 < labels.sum() < len(labels):
        return np.zeros(width, np.float32), float(np.log(share / (1 - share)))
    # A feature of one text can only learn that text by heart; those of identity terms stay to be held down.
    useful = np.bincount(np.concatenate(rows), minlength=width) > 1
    useful[np.abs(np.concatenate([*pairs, np.zeros(0, np.int64)])).astype(np.int64) - 1] = True
    used = np.flatnonzero(useful)
    place = np.where(useful, np.cumsum(useful) - 1, -1)
    compact = [own[own >= 0] for own in (place[r] for r in rows)]
    x = _Rows(compact)
    change = _Rows([place[np.abs(d) - 1] for d in pairs], [np.sign(d).astype(np.float64) for d in pairs])
    weights = np.zeros(len(used))
    ahead, momentum, rate = weights, 1.0, 8.0 / np.sqrt(np.mean([len(r) for r in compact]) + 1)
    last = np.inf
    for _ in range(steps):
        loss, slopes, tilt = loss_and_slopes(ahead, offset, x, labels, change, fairness)
        loss += sparse * np.abs(ahead).sum()
        if loss > last * 1.2:
            rate, ahead, momentum = rate / 2, weights, 1.0
            last = np.inf
            continue
        last = min(last, loss)
        step = ahead - rate * slopes
        new = np.sign(step) * np.maximum(np.abs(step) - rate * sparse, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        weights, momentum = new, following
        offset -= 2.0 * tilt
    scale, shift = rescaled(x.times(weights) + offset, labels, share)
    full = np.zeros(width, np.float32)
    full[used] = scale * weights
    return full, scale * offset + shift


def _list_features(terms: Sequence[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for cut in pieces([len(t) for t in texts]):
                row, feature = features_of(texts[cut])
                ends = np.searchsorted(row, np.arange(cut.stop - cut.start + 1)).astype(np.int32)
                own = batch.slice(cut.start, cut.stop - cut.start)
                pairs = [[d.tolist() for d in differences(t, terms)] for t in texts[cut]]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                     pa.array(pairs, pa.list_(pa.list_(pa.int32())))], names=["_key", "label", "features", "pairs"])
    return emit


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, folds: int = 4,
           held_out: int = 2, key: str = "doc_id", text: str = "text",
           terms: Sequence[str] = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, offset), from at most ``most`` labelled rows; see training_rows and fit.

    The texts become features where they lie; the driver sees features of the sample only. The sample has as many
    toxic rows as others where it can; scores are set to their share among all labelled rows.
    """
    python_ready(docs.sparkSession)
    rows = training_rows(docs, labels, label, most, folds, held_out, key, text)
    kind = docs.schema[key].dataType.simpleString()
    sample = rows.mapInArrow(
        _list_features(terms), f"_key {kind}, label int, features array<int>, pairs array<array<int>>").toArrow()
    order = np.argsort(np.array(sample["_key"].to_pylist(), dtype=object), kind="stable")
    lists = sample["features"].combine_chunks() if len(order) else pa.array([], pa.list_(pa.int32()))
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    marks = np.array(sample["label"].to_pylist(), np.float64)[order]
    known = labels.filter(F.col(label).isin(0, 1) & (fold(key, folds) != held_out))
    ones, every = known.agg(F.sum(label), F.count(label)).first()
    pairs = [np.array(d, np.int64) for own in sample["pairs"].to_pylist() for d in own]
    weights, offset = fit([flat[ends[i]:ends[i + 1]] for i in order], marks, pairs,
                          share=((ones or 0) + 0.5) / (every + 1))
    at = np.flatnonzero(weights)
    return at, weights[at], offset


def _score(features: np.ndarray, weights: np.ndarray, offset: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FEATURE_BITS, np.float64)
        table[features] = weights
        for batch in batches:
            texts = text_bytes(batch.column(1))
            sums = np.zeros(len(texts))
            for cut in pieces([len(t) for t in texts]):
                row, feature = features_of(texts[cut])
                sums[cut] = np.bincount(row, table[feature], cut.stop - cut.start)
            scores = 1 / (1 + np.exp(-np.clip(sums + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)],
                                             names=[batch.schema.names[0], "score"])
    return emit


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4,
           held_out: int = 2, **options) -> DataFrame:
    """(key, held_out, score) for every row of ``docs``; the score reads the whole text and nothing else.

    NULL and empty texts get the score of the offset alone. Repeated rows get equal scores. NULL keys are not
    held out. Without usable labels the score is near 0.5. Other columns are left behind.
    """
    features, weights, offset = fitted(docs, labels, key=key, text=text, folds=folds, held_out=held_out, **options)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(
        _score(features, weights, offset), f"`{key}` {kind}, score double")
    return rows.select(key, F.coalesce(fold(key, folds) == held_out, F.lit(False)).alias("held_out"), "score")
