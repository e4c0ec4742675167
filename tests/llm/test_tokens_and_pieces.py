"""Token files and the piece agenda against their libraries."""
from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import pieces_bpe, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "don't we'll I'd", "x y  z", "tab\tnew\nline\r\n end ", "!\x1c?",
       "▁literal ▁▁ x", "中文 字符", "\U0001f600 ok", "<s> </s> <unk> <0x41>", "a" * 300, "é" * 50 + " " * 40,
       "word\n\n\nword  \n x", "1234 5,678.90", "​zero\u0085next line", "ﬁ Ａ", "\x00 nul", "<|endoftext|>"]


def texts():
    rng = random.Random(5)
    alphabet = list("abc  \n\t.,'sé中 ▁!1") + ["the ", "ing ", "   "]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]


def test_pieces_agree_with_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, "kept") for i, t in enumerate([*texts(), "long words " * 20_000])]
    table = spark.createDataFrame([*rows, (None, None, "kept"), (0, "", "kept")], "doc_id bigint, text string, ids string")
    got = pieces_bpe.encoded(table, PIECES).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids, r.text
        assert r.decoded == library.decode(ids)
    assert pieces_bpe.encoded(table.limit(0), PIECES).count() == 0


def test_agenda_on_whole_texts(monkeypatch):
    model = pieces_bpe.PieceModel(PIECES)
    own = [t for t in texts() if t]
    units = ["▁" + t.replace(" ", "▁") for t in own]
    wanted = [np.array(model.library.encode(t), np.int32).tobytes() for t in own]
    assert model.merged(units) == wanted
    for short in (1, 1000):  # all by the heap, all side by side
        monkeypatch.setattr(pieces_bpe, "SHORT", short)
        monkeypatch.setattr(pieces_bpe, "AT_ONCE", 7 if short > 1 else 1)
        assert model.merged(units) == wanted
    assert model.merged([]) == [] and model.merged(["", "▁a"])[0] == b""


def test_a_difference_ends_the_job():
    model = pieces_bpe.PieceModel(PIECES)
    model.pairs.keys[:] = -1
    with pytest.raises(ValueError, match="library"):
        model.checked(["▁the"])


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    own = texts()
    rows = [(i, t, 1) for i, t in enumerate(own)] + [(4000, None, 1), (2, "second under that key", 1), (2, own[2], 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(5)
    path = str(tmp_path / "orc")
    token_files.write_tokens(table, path, BYTES)
    back = token_files.read_tokens(spark, path).collect()
    assert len(back) == len(rows)
    wanted = sorted((k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, _ in rows)
    assert sorted((r.doc_id, r.ids) for r in back) == wanted
    chosen = token_files.read_tokens(spark, path, [2, 7, 99_999])
    assert "PushedFilters: [In(doc_id" in chosen._jdf.queryExecution().toString().replace("\n", " ")
    assert sorted(r.doc_id for r in chosen.collect()) == [2, 2, 2, 7]
    got = token_files.stored(table, BYTES).collect()
    ordered = sorted(rows, key=lambda r: (r[0], zlib.crc32((r[1] or "").encode())))
    start, want = 0, []
    for k, t, _ in ordered:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_files.stored(table.limit(0), BYTES).count() == 0


def test_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    from pyarrow import orc

    path = str(tmp_path / "orc")
    monkeypatch.setitem(token_files.ORC_OPTIONS, "orc.stripe.size", str(64 << 10))
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcdefgh 0123", k=60))) for i in range(24_000)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), path, BYTES)
    files = sorted((tmp_path / "orc").glob("*.orc"))
    assert sum(orc.ORCFile(f).nstripes for f in files) > len(files)
    assert all(orc.ORCFile(f).compression == "ZSTD" and orc.ORCFile(f).row_index_stride == 1000 for f in files)
    hadoop = spark._jvm.org.apache.hadoop
    reader = spark._jvm.org.apache.orc.OrcFile
    kinds = set()
    for f in files:
        opened = reader.createReader(hadoop.fs.Path(str(f)), reader.readerOptions(hadoop.conf.Configuration()))
        inner = opened.rows()
        for stripe in opened.getStripes():
            footer = inner.readStripeFooter(stripe)
            kinds |= {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
        inner.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_a_text_of_megabytes(spark):
    from tokenizers import Tokenizer

    text = " ".join(f"word{i % 50_000}, ü{i}" for i in range(150_000)) + " " + "x" * 3000
    table = spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")
    (_, start, n, crc), second = sorted(map(tuple, token_files.stored(table, BYTES).collect()))
    ids = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids + [0]
    assert len(text) > 2_000_000 and (start, n, crc) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert second[1] == n


def test_units_that_are_new_reach_the_encoder_once():
    from quillspark.llm.token_files import _NOT_PLAIN, _SPACE, _UNIT
    from quillspark.llm.unit_cache import LONGEST_UNIT, UnitCache

    asked = []
    cache = UnitCache(lambda new: asked.append(sorted(new)) or [u.upper() for u in new], most=8)
    long = "x" * (LONGEST_UNIT + 1)
    assert cache.values([["a", "b", "a"], [], [long, "a"]]) == [["A", "B", "A"], [], [long.upper(), "A"]]
    assert cache.values([["b", "c"], [long]]) == [["B", "C"], [long.upper()]]
    assert cache.values([["d", "e", "f"]]) == [["D", "E", "F"]]  # half full: all become the older ones
    assert cache.values([["a", "g", "a"]]) == [["A", "G", "A"]]
    assert asked == [["a", "b", long], ["c", long], ["d", "e", "f"], ["g"]]
    text = "a b  c \n d　e  f\x85 \t" + " ".join(chr(c) for c in range(1, 0x3002) if not 0xd800 <= c < 0xe000)
    units = _UNIT.findall(text)
    plain = [u for u in units if u[0] == " " and u[1:2] not in _NOT_PLAIN]
    assert plain == [u for u in units if re.fullmatch(f" [^{_SPACE}]+", u)] and 0 < len(plain) < len(units)


def test_signs_behind_a_known_word_are_no_new_units():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    words = ["Brown", "féte", "Łódź", "zebra's", "x\u0301y", "中文", "a1b", "ʰa", "can't"]
    rng = random.Random(8)
    more = ["".join(rng.choices([*"aBé中.,'!1\u0301\x01", " ", "\n", " x", "'s", "re"], k=30)) for _ in range(500)]
    plain = [f"The {w} and {w}{s} then.\nNext {w}{s}" for w in words for s in ("", ",", ".", "!?", ")", '"')]
    encoder = token_files.TextEncoder(library)
    asked, encode = [], encoder.units.encode
    encoder.units.encode = lambda new: asked.extend(new) or encode(new)
    for own in (plain, [*plain, None], [*texts(), *more]):
        got = encoder(pa.array(own, pa.string()), 7).to_pylist()
        assert got == [library.encode(t or "", add_special_tokens=False).ids + [7] for t in own]
        if own is plain:
            assert " Brown" in asked and "," in asked and not any("Brown" in u for u in asked if u != " Brown")
            seen = len(asked)
    assert len(set(asked[:seen])) == seen and "Łódź" not in asked
    assert encoder(pa.array([], pa.string()), 0).to_pylist() == []
    encoder.encoder.runs = None  # as for a model with other rules: texts are cut at white space alone
    got = encoder(pa.array([*plain, *more]), 7).to_pylist()
    assert got == [library.encode(t, add_special_tokens=False).ids + [7] for t in [*plain, *more]]
