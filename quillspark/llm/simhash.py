"""SimHash near-dedup: deletion variants of few segments find the fingerprints that differ in two bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import Words, pieces, python_ready, text_bytes
from quillspark.llm.components import components
from quillspark.session import materialise

SHINGLE, SEED, BITS = 3, 42, 64
#: Two segments for two bits: one of them differs in at most one bit.
SEGMENT_BITS = 32
#: A bucket of more fingerprints than this is cut by further wildcards instead of compared pair by pair.
PAIRED_BUCKET = 64
_BLOCK = 1 << 15


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text (see with_fingerprints)."""
    words = Words([t.lower() for t in texts])  # bytes.lower() changes A-Z only
    counts = np.diff(words.first)
    several = np.maximum(counts - shingle + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), several)
    begin = np.repeat(words.first[:-1] - (np.cumsum(several) - several), several) + np.arange(len(text))
    end = np.minimum(begin + shingle, words.first[1:][text]) - 1
    data, digest = words.data, xxhash.xxh64_intdigest
    ones = np.zeros((len(texts), BITS), np.int64)
    for i in range(0, len(text), _BLOCK):
        own = text[i:i + _BLOCK]
        spans = zip(words.starts[begin[i:i + _BLOCK]].tolist(), words.ends[end[i:i + _BLOCK]].tolist())
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(own))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    most = 2 * ones > several[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def _add_fingerprints(shingle: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            parts = [fingerprints_of(texts[cut], shingle) for cut in pieces([len(t) for t in texts])]
            prints = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)],
                                             names=[batch.schema.names[0], "fingerprint"])
    return emit


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint): the SimHash of each row's whole text as a bigint.

    A-Z are lower-cased; shingles are ``shingle`` consecutive words joined by a space, as often as they come
    (all words if there are fewer); a bit is 1 if it is set in over half of their XXH64 (seed 42). NULL,
    empty and blank texts have fingerprint 0.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        _add_fingerprints(shingle), f"`{key}` {kind}, fingerprint bigint")


def _segment(number: int) -> Column:
    """Segment 0 holds the low 32 bits, segment 1 the high ones."""
    return F.shiftrightunsigned("fp", SEGMENT_BITS * number).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.cast("int"))


def _wild(value: Column, bit: Column) -> Column:
    """The value with a wildcard (a cleared bit) at one place."""
    return value.bitwiseAND(F.bitwise_not(_bit(bit)))


def _variants(prints: DataFrame) -> DataFrame:
    """fp, p, v, on: each segment with each of its bits a wildcard (p from 0 to 63; ``on`` is that bit), and
    each segment whole (p 64 and 65)."""
    wild = F.col("p") < BITS
    number = F.when(wild, F.floor(F.col("p") / SEGMENT_BITS)).otherwise(F.col("p") - BITS)
    segment = F.when(number == 0, _segment(0)).otherwise(_segment(1))
    place = F.col("p") % SEGMENT_BITS
    listed = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS + 1))).alias("p"))
    return listed.select(
        "fp", F.col("p").cast("byte").alias("p"), F.when(wild, _wild(segment, place)).otherwise(segment).alias("v"),
        (wild & (segment.bitwiseAND(_bit(place)) != 0)).alias("on"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``fp``, that join any two that differ in at most
    two bits, directly or by way of others that do.

    Of two such fingerprints one segment differs in at most one bit. If it is equal, they share that whole
    segment; if it differs in bit p, they share the variant with a wildcard at p, with p off in one and on
    in the other. So each pair is met once for each segment. Buckets of up to PAIRED_BUCKET members are
    compared pair by pair and verified. In a larger bucket
      - with a wildcard p, a second wildcard j in the other segment makes groups that differ in p and j only;
      - with a whole segment, two wildcards in the other one make groups that differ in those only;
    so each group is all links, and linking its members to the least joins them. No pair is left out, and
    no bucket gives more than a fixed number of rows for each member.

    Spark takes the rows of an explode to be as large as what is exploded, and a written table to be as large as its
    compressed files, so it would broadcast what no driver can hold. The joins are therefore sort-merge joins.
    """
    variants = _variants(prints)
    buckets = variants.groupBy("p", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("on").cast("int")).alias("on")).filter(
        F.when(F.col("p") < BITS, (F.col("on") > 0) & (F.col("on") < F.col("n"))).otherwise(F.col("n") > 1))
    buckets = buckets.select(F.col("p").alias("q"), F.col("v").alias("w"),
                             (F.col("n") > PAIRED_BUCKET).alias("large"))
    same_bucket = (F.col("p") == F.col("q")) & (F.col("v") == F.col("w"))
    members = materialise(variants.join(buckets.hint("merge"), same_bucket).select("fp", "p", "v", "on", "large"))
    small = members.filter("NOT large").select("fp", "p", "v", "on")
    other = small.select(F.col("fp").alias("fq"), F.col("p").alias("q"), F.col("v").alias("w"),
                         F.col("on").alias("onq"))
    once = F.when(F.col("p") < BITS, ~F.col("on") & F.col("onq")).otherwise(F.col("fp") < F.col("fq"))
    near = small.join(other.hint("merge"), same_bucket & once).filter(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= 2).select(
        F.col("fp").alias("a"), F.col("fq").alias("b"))
    first = F.when(F.col("p") < BITS, F.col("p") < SEGMENT_BITS).otherwise(F.col("p") == BITS)
    large = members.filter("large").withColumn("rest", F.when(first, _segment(1)).otherwise(_segment(0)))
    places = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    one = large.filter(F.col("p") < BITS).select("fp", "p", "v", "rest", F.explode(places).alias("j"))
    one = one.select("fp", "p", "v", "j", F.lit(-1).alias("k"), _wild(F.col("rest"), F.col("j")).alias("rest"))
    two = large.filter(F.col("p") >= BITS).select("fp", "p", "v", "rest", F.explode(places).alias("j"))
    two = two.select("*", F.explode(F.sequence(F.col("j") + 1, F.lit(SEGMENT_BITS))).alias("k")).filter(
        F.col("k") < SEGMENT_BITS)
    two = two.select("fp", "p", "v", "j", "k",
                     _wild(_wild(F.col("rest"), F.col("j")), F.col("k")).alias("rest"))
    return near.union(_stars(one.union(two)))


def _stars(groups: DataFrame) -> DataFrame:
    """Links every other member of a group to the least. The groups come from explodes, see links()."""
    same = ["p", "v", "j", "k", "rest"]
    least = groups.groupBy(*same).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    least = least.select(*[F.col(c).alias(f"_{c}") for c in same], "a")
    return groups.join(least.hint("merge"), reduce(and_, (F.col(c) == F.col(f"_{c}") for c in same))).filter(
        "fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) for every row: component_id is the least key whose fingerprint can be
    reached by steps of at most two bits.

    Equal fingerprints are one node, so copies cost one row each and no pairs. NULL keys never name a
    component unless it has no other key. Repeated rows give repeated rows. Other columns are left behind.
    An empty table gives an empty one. Tables that grow with the input are not broadcast, see links().
    """
    prints = materialise(with_fingerprints(docs, key, text, shingle))
    nodes = materialise(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least")))
    reached = components(links(nodes.select("fp")))
    joined = nodes.join(reached.hint("merge"), F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialise(joined.select(F.col("fp"), F.col("root").alias("_root")).join(
        ids, F.col("_root") == F.col("root")).select("fp", "component_id"))
    return prints.join(of_print.hint("merge"), F.col("fingerprint") == F.col("fp")).select(
        key, "fingerprint", "component_id")
