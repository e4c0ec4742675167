"""Secrets in texts: three patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready, stored, text_bytes

#: Kinds of spans, in order of their names in a result; the last one is the models' own.
KINDS = ("assign", "access", "hex", "random")
ASSIGN, ACCESS, HEX, RANDOM = range(4)
#: Read on texts with A-Z lower-cased, so that letters count in either case.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Characters of a model, one number each; runs of them are the strings that are judged.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SIZE = len(ALPHABET)
_NUMBER = np.full(256, SIZE, np.uint8)
_NUMBER[list(ALPHABET)] = np.arange(SIZE)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: Runs of the first length or more are judged. Shorter ones, of the second or more, teach the ordinary model; those that
#: are judged do not, so an unknown secret never vouches for itself.
LEAST_JUDGED, LEAST_LEARNED = 20, 6
#: A run is random if its log-likelihood ratio is at least this, in all and for each pair of characters.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.5
#: What random strings look like before any sample is seen: pairs of one of these alphabets, each as likely.
RANDOM_ALPHABETS = (ALPHABET[52:62] + b"abcdef", ALPHABET[52:62] + b"ABCDEF", ALPHABET[:62], ALPHABET[26:62],
                    ALPHABET[:62] + b"+/", ALPHABET[:62] + b"_-")
#: Shares of a model that come from no sample, so a model behaves alike however large its sample is.
PRIOR_SHARE, UNIFORM_SHARE = 0.5, 0.01


def _mask_runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each place is in one of the spans."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def base_spans(data: bytes) -> np.ndarray:
    """Rows (kind, start, end, start of the secret) of the three patterns in order of their starts, then of KINDS.
    Matches of a kind are leftmost and do not overlap; one that is too short is dropped after it took its place."""
    found = [(ASSIGN, m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(data.lower())
             if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    found += [(ACCESS, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(data)
              if m.end() - m.start() >= LEAST_ACCESS]
    starts, ends = _mask_runs(_HEX[np.frombuffer(data, np.uint8)], LEAST_HEX)
    found += [(HEX, a, b, a) for a, b in zip(starts.tolist(), ends.tolist())]
    return np.array(sorted(found, key=lambda f: (f[1], f[0])), np.int64).reshape(-1, 4)


def scan(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base_spans, the starts and ends of the runs to judge, and the pairs of characters in labelled strings.

    The last are counts [2, SIZE * SIZE]: 1 of the strings that a pattern found (of an assignment, the value), 0 of the
    runs that no pattern touches, from LEAST_LEARNED to below LEAST_JUDGED. Longer ones are judged.
    """
    base = base_spans(data)
    numbers = _NUMBER[np.frombuffer(data, np.uint8)]
    starts, ends = _mask_runs(numbers < SIZE, LEAST_LEARNED)
    touched = _inside(len(starts), np.searchsorted(ends, base[:, 1], "right"), np.searchsorted(starts, base[:, 2], "left"))
    starts, ends = starts[~touched], ends[~touched]
    pair = numbers[:-1].astype(np.int64) * (SIZE + 1) + numbers[1:]
    judged, counts = ends - starts >= LEAST_JUDGED, []
    for a, b in ((starts[~judged], ends[~judged]), (base[:, 3], base[:, 2])):
        own = _inside(len(data), a, b)
        table = np.bincount(pair[own[:-1] & own[1:]], minlength=(SIZE + 1) ** 2).reshape(SIZE + 1, SIZE + 1)
        counts.append(table[:SIZE, :SIZE].ravel())
    return base, starts[judged], ends[judged], np.array(counts)


_SPANS = "array<struct<kind: int, start: bigint, end: bigint>>"
_RUNS = "array<struct<start: bigint, end: bigint, value: binary>>"


def _list_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the end of a task one with the pairs of all of its strings."""
    total, names = np.zeros((2, SIZE * SIZE), np.int64), ["key", "base", "runs", "pairs"]
    kinds = [pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])),
             pa.list_(pa.int64())]
    key = None
    for batch in batches:
        texts = text_bytes(batch.column(1))
        key = batch.column(0).type
        for cut in pieces([len(t) for t in texts]):
            own = texts[cut]
            data = b"\n".join(own) + b"\n"  # no pattern and no run holds this, so none crosses texts
            begin = np.cumsum([0, *(len(t) + 1 for t in own)])
            base, starts, ends, counts = scan(data)
            total += counts
            points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
            rows = [([], []) for _ in own]
            for of, (kind, a, b, _) in zip((np.searchsorted(begin, base[:, 1], "right") - 1).tolist(), base.tolist()):
                first = points[begin[of]]
                rows[of][0].append({"kind": kind, "start": points[a] - first, "end": points[b] - first})
            for of, a, b in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
                first = points[begin[of]]
                rows[of][1].append({"start": points[a] - first, "end": points[b] - first, "value": data[a:b]})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(cut.start, len(own)), pa.array([r[0] for r in rows], kinds[0]),
                 pa.array([r[1] for r in rows], kinds[1]), pa.nulls(len(own), kinds[2])], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]),
                                          pa.array([total.ravel().tolist()], kinds[2])], names=names)


def _chances(counts: np.ndarray, prior: np.ndarray, share: float) -> np.ndarray:
    """The chance of each character after each: the counted share, and ``share`` of the prior; the prior alone for a
    character that was never counted."""
    every = counts.sum(axis=1, keepdims=True)
    counted = np.divide(counts, every, out=prior.copy(), where=every > 0)
    return (1 - share) * counted + share * prior


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """[SIZE + 1, SIZE + 1]: the logarithm of a pair's chance in random strings over its chance in ordinary ones."""
    ordinary, random = np.asarray(counts, np.float64).reshape(2, SIZE, SIZE)
    uniform = np.full((SIZE, SIZE), 1 / SIZE)
    drawn = np.zeros((SIZE, SIZE))
    for alphabet in RANDOM_ALPHABETS:
        at = _NUMBER[list(alphabet)]
        drawn[np.ix_(at, at)] += 1 / len(at) ** 2
    every = drawn.sum(axis=1, keepdims=True)
    drawn = np.divide(drawn, every, out=uniform.copy(), where=every > 0)
    drawn = (1 - UNIFORM_SHARE) * drawn + UNIFORM_SHARE * uniform
    return np.log(_chances(random, drawn, PRIOR_SHARE)) - np.log(_chances(ordinary, uniform, UNIFORM_SHARE))


def is_random(value: bytes, ratios: np.ndarray) -> bool:
    at = _NUMBER[np.frombuffer(value, np.uint8)]
    own = ratios[at[:-1], at[1:]]
    return bool(own.sum() >= max(LEAST_RATIO, LEAST_MEAN * len(own)))


def _judge(ratios: np.ndarray):
    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(s["start"], s["kind"], s["end"]) for s in base]
                counts.append([sum(kind == k for _, kind, _ in own) for k in (ASSIGN, ACCESS, HEX)])
                digests.append(hashlib.sha256(joined(own).encode()).hexdigest())
                spans.append(joined(own + [(r["start"], RANDOM, r["end"]) for r in runs if is_random(r["value"], ratios)]))
            columns = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())], names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return emit


def trained(rows: DataFrame) -> np.ndarray:
    """log_ratios of the labelled strings of all texts; the driver gets one number for each label and pair."""
    counts = np.zeros(2 * SIZE * SIZE, np.int64)
    every = rows.filter("pairs IS NOT NULL").select(F.posexplode("pairs").alias("at", "n")).filter("n > 0")
    for r in every.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r.n
    return log_ratios(counts)


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    The patterns' spans stay. They are also the labelled samples of random strings; the runs of six to nineteen
    characters of ALPHABET elsewhere in all texts are those of ordinary identifiers. Of each label a first-order Markov model
    is made, and a run of LEAST_JUDGED or more that no pattern touches becomes a span of the kind ``random`` if the
    likelihood ratio of the two is high enough. Places are code points, ends exclusive. NULL texts count as empty,
    which have no spans; repeated rows and NULL keys are rows like others; other columns are left behind; without
    any sample, the random model is its prior and the ordinary one is uniform.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = stored(docs.select(F.col(key), F.col(text)).mapInArrow(
        _list_spans, f"key {kind}, base {_SPANS}, runs {_RUNS}, pairs array<bigint>"))
    ratios = trained(rows)
    out = rows.filter("pairs IS NULL").select("key", "base", "runs").mapInArrow(
        _judge(ratios), f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)
