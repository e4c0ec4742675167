"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import pieces, python_ready
from quillspark.llm.unit_cache import UnitCache
from quillspark.operators.ordering import with_running_total
from quillspark.session import materialise, scratch_root

#: Characters that the byte-level tokenizer's pattern takes for white space. A token never spans the border
#: between a character of another kind and one of these, so what lies between such borders is encoded alone.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Where a text is cut before its parts are looked up; texts that hold this character are not cut.
_CUT = "\x01"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_RUN = re.compile(f" ?[{_LETTERS}]+")
#: The library's pattern ends a token between a letter (such ones as every version of Unicode has for letters) and an
#: ASCII character that is none; a single space begins one, a single line end is one.
_RUN_ENDS = f"([{_LETTERS}])([!-@\\[-`{{-~])"
#: Texts with other white space than single ones between words.
_ODD_SPACE = f"[{_SPACE}]{{2}}|^[{_SPACE}]|[{_SPACE}]$|{_CUT}"
END_ID = 0
#: Units whose ids a worker keeps, some 200 bytes each.
MOST_UNITS = 1_000_000

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
}


_AT_ONCE = 200
#: A unit that starts with one space and holds no other white space is encoded line by line. White space is only at the
#: start of a unit, or all of it, so the second character tells, or that there is none.
_NOT_PLAIN = frozenset(["", *(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))])


class UnitEncoder:
    """The library's ids of units (matches of _UNIT and parts of them), as bytes of int32.

    Plain units go to the library as the lines of one text, for which it makes one result instead of thousands; the
    token of the line's end, which is no part of another token, tells them apart. What cannot go that way, does alone:
    units with other white space, texts that hold the name of a special token, and all if the model has other rules.

    A run of letters is one match of the library's pattern, so lines of such runs go to a second one, with the same
    model and the same bytes, that only cuts at the ends of lines.
    """

    def __init__(self, library):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = library
        rules = library.pre_tokenizer
        self.runs = None
        names = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names) or r"(?!)")
        line = self.one("\n")
        self.line = int(np.frombuffer(line, np.int32)[0]) if len(line) == 4 else None
        probes = [" a", " don't", " 12345", " \u00e9t\u00e9,", " \u6771\u4eac", " ...!?", " x\u0301", " \U0001f98a"]
        if self.line is not None and self.lines(probes) != [self.one(p) for p in probes]:
            self.line = None
        if self.line is not None and library.normalizer is None and isinstance(rules, pre_tokenizers.ByteLevel) and (
                rules.use_regex and not rules.add_prefix_space):
            self.runs = Tokenizer.from_str(library.to_str())
            self.runs.normalizer = normalizers.ByteLevel()
            self.runs.pre_tokenizer = pre_tokenizers.Split(library.id_to_token(self.line), "isolated")
            probes = [" a", "a", " the", "The", " \u00e9t\u00e9", "\u00dcber", " \u0141\u00f3d\u017a", " don"]
            if self.lines(probes, self.runs) != [self.one(p) for p in probes]:
                self.runs = None

    def one(self, unit: str) -> bytes:
        return np.array(self.library.encode(unit, add_special_tokens=False).ids, np.int32).tobytes()

    def lines(self, units: list[str], library=None) -> list[bytes] | None:
        """None if the ids cannot be told apart."""
        text = "\n".join(units)
        if self.special.search(text):
            return None
        ids = np.array((library or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.append(np.flatnonzero(ids == self.line), len(ids))
        if len(ends) != len(units):
            return None
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], cuts)]

    def alone(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes()
                for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def __call__(self, units: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        runs, plain, rest = [], [], []
        for u in units:
            if not u:
                out[u] = b""
            elif self.runs and _RUN.fullmatch(u):
                runs.append(u)
            else:
                (plain if u[0] == " " and u[1:2] not in _NOT_PLAIN else rest).append(u)
        if self.line is None:
            plain, rest = [], units
        for some, library in ((runs, self.runs), (plain, self.library)):
            for i in range(0, len(some), _AT_ONCE):
                own = some[i:i + _AT_ONCE]
                ids = self.lines(own, library)
                if ids is None:
                    rest.extend(own)
                else:
                    out.update(zip(own, ids))
        for i in range(0, len(rest), _AT_ONCE):
            own = rest[i:i + _AT_ONCE]
            out.update(zip(own, self.alone(own)))
        return list(map(out.__getitem__, units))


class TextEncoder:
    """The library's ids of whole texts.

    Arrow cuts the texts of a batch into units and finds the distinct ones, which are looked up. Units end where the
    library's pattern ends a token in any case: signs behind a word are a unit of their own, as many words that are new
    to a worker differ from known ones only in these.
    """

    def __init__(self, library, most: int = MOST_UNITS):
        self.encoder = UnitEncoder(library)
        self.names = [t.content for t in library.get_added_tokens_decoder().values()]
        self.units = UnitCache(self.encoder, most)

    def _whole(self, texts: pa.Array) -> pa.Array:
        """Which texts only _UNIT can cut."""
        if not self.encoder.runs:
            return pa.repeat(True, len(texts))
        return reduce(pc.or_, [pc.match_substring(texts, n) for n in self.names],
                      pc.match_substring_regex(texts, _ODD_SPACE))

    def __call__(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text, and ``end_id``."""
        texts = pc.fill_null(texts, "")
        whole = self._whole(texts)
        cut = pc.replace_substring(pc.if_else(whole, "", texts), " ", f"{_CUT} ")
        cut = pc.replace_substring(cut, "\n", f"{_CUT}\n{_CUT}")
        split = pc.split_pattern(pc.replace_substring_regex(cut, _RUN_ENDS, f"\\1{_CUT}\\2"), _CUT)
        coded = split.values.dictionary_encode()
        ids = self.units.flat(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        others = [_UNIT.findall(t) for t in texts.filter(whole).to_pylist()]
        n = len(ids)
        ids += [*map(b"".join, self.units.values(others)), np.int32(end_id).tobytes()]
        # A row is its units, or what stands for the whole text, and the end.
        begin, chosen = np.asarray(split.offsets), np.asarray(coded.indices).astype(np.int64)
        chosen[begin[:-1][np.asarray(whole)]] = n + np.arange(len(others))
        order = np.insert(chosen, begin[1:], len(ids) - 1)
        offsets = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        bounds = np.cumsum(np.diff(offsets)[order])[begin[1:] + np.arange(len(texts))]
        return pa.ListArray.from_arrays(pa.array(np.append(0, bounds), pa.int32()), lists.take(pa.array(order)).flatten())


@lru_cache(maxsize=1)
def _encoder(model: str) -> TextEncoder:
    """One for each worker process, which keeps it from task to task. Spark's tasks are the threads, so the library
    starts none of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return TextEncoder(Tokenizer.from_file(model))


def _encode(model: str, end_id: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for cut in pieces(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                own = batch.slice(cut.start, cut.stop - cut.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), encoder(own.column(2), end_id)],
                                                 names=["doc_id", "text_crc32", "ids"])
    return emit


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = END_ID, key: str = "doc_id",
                 text: str = "text") -> None:
    """Writes doc_id, text_crc32 and ids of each row as ORC, in ascending order of the key over all files.

    Ids are those of the whole text by the tokenizers library, without special tokens, and ``end_id`` at the
    end; NULL and empty texts have that one only. Texts are sorted before they are encoded, as they are
    smaller than their ids. NULL keys come first; rows with equal keys are in order of the text's crc32.
    An empty table gives a file without rows. Other columns are left behind.
    """
    python_ready(docs.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.crc32(content.cast("binary")).alias("text_crc32"),
                       content.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id", "text_crc32").sortWithinPartitions("doc_id", "text_crc32")
    ordered.mapInArrow(_encode(model, end_id), f"doc_id {kind}, text_crc32 bigint, ids array<int>").write.options(
        **ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of such files; with ``ids``, those documents only: the reader skips files and stripes by their
    ranges and row groups by the Bloom filters. Stripes are read in parallel."""
    rows = spark.read.orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(list(ids)))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets)
        data = np.asarray(lists.values).astype("<u4", copy=False)
        sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)),
             pa.array(sums, pa.int64())], names=["doc_id", "text_crc32", "n_tokens", "ids_crc32"])


def stored(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files to the shared folder, reads them back, and tells for each row: doc_id, start (the ids of
    all rows before it), n_tokens and ids_crc32 of what was read."""
    spark = docs.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, model, key=key, text=text)
    back = read_tokens(spark, path)
    kind = back.schema["doc_id"].dataType.simpleString()
    sums = materialise(back.mapInArrow(_sum_up, f"doc_id {kind}, text_crc32 bigint, n_tokens bigint, ids_crc32 bigint"))
    order = [F.col("doc_id"), F.col("text_crc32")]
    totals = with_running_total(sums, [], order, "n_tokens")
    return totals.select("doc_id", (F.col("running_total") - F.col("n_tokens")).alias("start"), "n_tokens",
                         "ids_crc32")
