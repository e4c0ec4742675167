"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent pairs by score."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready
from quillspark.llm.unit_cache import UnitCache

SPACE = "\u2581"
#: Units of so many characters are merged side by side, so many at once; longer ones one by one.
SHORT, AT_ONCE = 40, 50_000
NO_PIECE = 1 << 30
#: A symbol is the id of a piece or, from the vocabulary's size on, a character that is none.
SYMBOL_BITS = 21


class PairTable:
    """An open hash table of pairs of symbols, looked up for many at once."""

    def __init__(self, rows: Iterator[tuple[int, int, int, int]]):
        left, right, rank, piece = np.array(list(rows), np.int64).reshape(-1, 4).T
        self.bits = max(4, int(2 * len(left)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.piece = np.full(1 << self.bits, NO_PIECE, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = left << SYMBOL_BITS | right
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[slot[open_]] < 0
            self.keys[slot[open_[free]]] = keys[open_[free]]
            placed = self.keys[slot[open_]] == keys[open_]
            done, open_ = open_[placed], open_[~placed]
            self.rank[slot[done]], self.piece[slot[done]] = rank[done], piece[done]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of each pair; NO_PIECE if it forms none."""
        keys = left << SYMBOL_BITS | right
        slot = self._slots(keys)
        there = self.keys[slot]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            there[other] = self.keys[slot[other]]
            other = other[(there[other] != keys[other]) & (there[other] >= 0)]
        return np.where(there == keys, self.rank[slot], NO_PIECE), self.piece[slot]


class PieceModel:
    """A merge-type vocabulary with byte fallback, read through the sentencepiece library.

    Texts are not normalised, a space is put before each, and spaces become U+2581: what the library does
    for a model with the identity rule. Other models are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (
            lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        order = {s: n for n, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        #: 0 is merged first; pieces of equal score share a rank, and the leftmost pair goes first.
        self.rank = {names[i]: order[lib.get_score(i)] for i in plain if len(names[i]) > 1}
        self.size = size
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + size
        for name, i in self.ids.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = i
        self.pairs = PairTable(self._splits())
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(lib.is_byte, self.byte_ids)) or lib.encode("Ａ  x ", out_type=str) != [
                x for part in (f"{SPACE}Ａ", f"{SPACE * 2}x", SPACE) for x in self._names(part)]:
            raise ValueError("not a merge-type model with byte fallback and without normalisation")
        inner = any(SPACE in n.lstrip(SPACE) for n in self.ids)
        lines = any("\n" in n for n in self.ids)
        # No piece holds a border between units, so no merge crosses it and units are encoded alone.
        self.unit = re.compile(r"(?s).+" if inner else f"{SPACE}+[^{SPACE}]*" if lines else
                               f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")

    def _splits(self) -> Iterator[tuple[int, int, int, int]]:
        """(left, right, rank, piece) for each way in which a piece is two symbols."""
        for name, rank in self.rank.items():
            for cut in range(1, len(name)):
                sides = [self.ids.get(s, self.size + ord(s) if len(s) == 1 else None) for s in (name[:cut], name[cut:])]
                if None not in sides:
                    yield *sides, rank, self.ids[name]

    def _names(self, unit: str) -> list[str]:
        return [self.library.id_to_piece(i) for i in array("i", self.merged([unit])[0])]

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merged(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as int32: of all its adjacent pairs that form a piece, the one with the best score (the
        leftmost of equal ones) is merged, until none is left; what is no piece falls back to its bytes."""
        out = [b""] * len(units)
        short = [i for i, u in enumerate(units) if 0 < len(u) <= SHORT]
        for i in range(0, len(short), AT_ONCE):
            own = short[i:i + AT_ONCE]
            for k, ids in zip(own, self._together([units[k] for k in own])):
                out[k] = ids
        for k, u in enumerate(units):
            if len(u) > SHORT:
                out[k] = self._as_ids([self.ids.get(s, self.size + ord(s[0])) for s in self._long(u)])
        return out

    def _as_ids(self, symbols: list[int]) -> bytes:
        """Symbols from ``size`` on are characters that are no piece."""
        return array("i", [i for s in symbols for i in (
            [s] if s < self.size else map(self.byte_ids.__getitem__, chr(s - self.size).encode()))]).tobytes()

    def _together(self, units: list[str]) -> list[bytes]:
        """merged() for many units at once. The agenda holds, for every symbol, the rank of its pair with the next one;
        in each round every unit takes the least of its ranks, and two of the ranks beside that pair change."""
        out, unit = [b""] * len(units), np.arange(len(units))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(lengths) - lengths
        symbols = self.symbol_of[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        agenda, into = self.pairs.found(symbols, np.append(symbols[1:], 0))
        agenda[first + lengths - 1] = NO_PIECE
        while len(unit):
            size = len(agenda)
            best = np.minimum.reduceat(agenda * size + np.arange(size), first)
            at, going = best % size, best // size < NO_PIECE
            if not going.all():
                ended = np.repeat(~going, lengths)
                ids, cuts = symbols[ended], np.cumsum(lengths[~going])
                data, known = ids.astype(np.int32).tobytes(), np.minimum.reduceat(ids < self.size, cuts - lengths[~going])
                for k, a, b, plain in zip(unit[~going].tolist(), [0, *cuts.tolist()], cuts.tolist(), known.tolist()):
                    out[k] = data[4 * a:4 * b] if plain else self._as_ids(ids[a:b].tolist())
                symbols, agenda, into = symbols[~ended], agenda[~ended], into[~ended]
                at = (np.cumsum(~ended) - 1)[at[going]]
                unit, lengths = unit[going], lengths[going]
            symbols[at] = into[at]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            symbols, agenda, into = symbols[left], agenda[left], into[left]
            at = at - np.arange(len(at))  # each unit before has lost one symbol
            lengths = lengths - 1
            first = np.cumsum(lengths) - lengths
            last = at == first + lengths - 1
            agenda[at[last]] = NO_PIECE
            for place in (at[~last], at[at > first] - 1):
                agenda[place], into[place] = self.pairs.found(symbols[place], symbols[place + 1])
        return out

    def _long(self, unit: str) -> list[str]:
        """The agenda is a heap; a pair that has been merged since is passed over."""
        rank, symbols = self.rank, list(unit)
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = []
        for i in range(size - 1):
            pair = symbols[i] + symbols[i + 1]
            r = rank.get(pair)
            if r is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if left is None or j >= size or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                wider = pair + symbols[k]
                r = rank.get(wider)
                if r is not None:
                    heapq.heappush(agenda, (r, i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                r = rank.get(wider)
                if r is not None:
                    heapq.heappush(agenda, (r, h, wider))
        return [s for s in symbols if s is not None]

    def checked(self, units: list[str]) -> list[bytes]:
        """The ids of new units as int32, held against the library's ids for the same units in one call."""
        own = self.merged(units)
        known = [i for i, u in enumerate(units) if u != SPACE]  # the library adds the first space by itself
        asked = [units[i][1:] if units[i].startswith(SPACE) else "\n" + units[i] for i in known]
        theirs = self.library.encode([a.replace(SPACE, " ") for a in asked], num_threads=1)
        for i, ids in zip(known, theirs):
            if own[i] != array("i", ids if units[i].startswith(SPACE) else ids[2:]).tobytes():
                raise ValueError(f"the library encodes {units[i]!r} as {ids}, not as {array('i', own[i]).tolist()}")
        return own


@lru_cache(maxsize=1)
def _loaded(model: str) -> tuple[PieceModel, UnitCache]:
    """One for each worker process, which keeps it from task to task."""
    vocabulary = PieceModel(model)
    return vocabulary, UnitCache(vocabulary.checked)


def _encode(model: str, at: int):
    """Adds ids and decoded to each row; column ``at`` is the text."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = _loaded(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for cut in pieces([len(t) for t in texts], 500_000):
                parts = cache.values([vocabulary.units(t) for t in texts[cut]])
                ids = [b"".join(own) for own in parts]
                offsets = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                whole = flat.tolist()
                lists = [whole[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                decoded = vocabulary.library.decode(lists, num_threads=1)
                own = batch.slice(cut.start, cut.stop - cut.start)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array(decoded, pa.string())], names=[*own.schema.names, "ids", "decoded"])
    return emit


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (as the sentencepiece library gives them, without begin or end ids or sampling) and
    decoded, the text that the library's decode gives for the ids.

    Units between borders that no piece crosses are encoded once for each batch and kept in a bounded cache; the
    agenda's ids of every new unit are held against the library's, and a difference ends the job. NULL and
    empty texts have no ids and decode to the empty text. All rows and columns are kept; columns called ids or
    decoded are replaced. Nothing is shuffled. An empty table gives an empty one.
    """
    python_ready(docs.sparkSession)
    rows = docs.drop("ids", "decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_encode(model, rows.columns.index(text)), f"{kinds}, ids array<int>, decoded string")
