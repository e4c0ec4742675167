"""A special token's name in a text, against the tokenizers library as its file sets it."""
from __future__ import annotations

import random

import pytest

from quillspark.llm import token_files
from test_tokens_and_pieces import BYTES, texts

END = "<|endoftext|>"


def test_names_of_special_tokens_in_texts(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(BYTES)
    assert library.encode(f"end {END} next", add_special_tokens=False).ids == [437, 220, 50256, 1306]
    rng = random.Random(3)
    bits = [END, END, " ", "  ", "\n", "\t ", "a", "'s", "the end", "中", ".", "<|end", "oftext|>", " "]
    own = [*texts(), f"end {END} next", *("".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(400))]
    table = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(3)
    path = str(tmp_path / "orc")
    token_files.write_tokens(table, path, BYTES)
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    for i, t in enumerate(own):
        assert got[i] == library.encode(t, add_special_tokens=False).ids + [0], t
