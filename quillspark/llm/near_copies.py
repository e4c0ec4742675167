"""Near copies for the pipeline: wide SimHashes over five-word shingles name candidates, their shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import Words, mixed, pieces, python_ready, same_key, stored, text_bytes
from quillspark.llm.components import components
from quillspark.session import gathered, materialise

SHINGLE, SEED, SIMILAR = 5, 42, 0.8
WORDS = 4
BITS = 64 * WORDS
#: Two sets of Jaccard similarity 0.8 differ in 39 of 256 bits in the mean, with a deviation of 5.7.
MOST_BITS = 60
#: Segments are cut from so many orders of the bits; each is met under the variants of its least certain bits.
SEGMENT_BITS, ORDERS, TURNED = 32, 3, 4
_ORDER = np.concatenate([np.random.RandomState(i).permutation(BITS) for i in range(ORDERS)]).reshape(-1, SEGMENT_BITS)
SEGMENTS = len(_ORDER)
#: Segments whose variants are on disk at the same time: so many, or three times as many if there are few nodes.
AT_ONCE, FEW_NODES = 4, 100_000
_BLOCK = 1 << 13
_SALTS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(WORDS)], np.uint64)
_PRINT = [f"h{i}" for i in range(WORDS)]
#: Cells of a set's parity map, and what two nodes are compared by.
CELLS = 1024
_PARITY = [f"p{i}" for i in range(CELLS // 64)]
_COMPARED = [*_PRINT, "size", *_PARITY]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct XXH64 of each text's shingles, ascending: five consecutive words, A-Z lower-cased, joined by a
    space; all words if there are fewer; none if there are none."""
    words = Words([t.lower() for t in texts])  # bytes.lower() changes A-Z only
    data, digest, out = words.data, xxhash.xxh64_intdigest, []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        begins = words.starts[a:max(b - SHINGLE + 1, min(a + 1, b))].tolist()
        ends = words.ends[min(a + SHINGLE, b) - 1:b].tolist()
        out.append(np.unique(np.fromiter((digest(data[i:j], SEED) for i, j in zip(begins, ends)), np.uint64,
                                         len(begins))))
    return out


def _margins(own: np.ndarray) -> np.ndarray:
    """For each bit, in how many of the shingles' hashes it is set more often than not."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(own), _BLOCK):
        wide = mixed(own[i:i + _BLOCK, None] ^ _SALTS)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * ones - len(own)


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, whether the number of its shingles in each of CELLS cells is odd, as bits of 64-bit words."""
    odd = np.array([np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1 for s in sets], np.uint8)
    return np.packbits(odd.reshape(-1, CELLS), axis=1, bitorder="little").view(np.int64)


def _add_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "fp", *_COMPARED, "places"]
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for cut in pieces([len(t) for t in texts]):
            sets = shingle_sets(texts[cut])
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
            margins = np.array([_margins(s) for s in sets])
            prints = np.packbits(margins > 0, axis=1, bitorder="little").view(np.int64)
            least = np.argsort(np.abs(margins)[:, _ORDER], axis=2, kind="stable")[:, :, :TURNED].astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(cut.start, len(sets)), pa.array(fps.view(np.int64)),
                 *[pa.array(np.ascontiguousarray(p)) for p in prints.T], pa.array([len(s) for s in sets], pa.int64()),
                 *[pa.array(np.ascontiguousarray(p)) for p in _parities(sets).T],
                 pa.array([p.tobytes() for p in least], pa.binary())], names=names)


def _variants(first: int, many: int):
    """fp and v for the segments from ``first`` on: the segment and its bits, with any of the least certain ones
    turned. Two prints meet if each bit in which the segment differs is among those of one of them."""
    order = _ORDER[first:first + many]
    number = np.arange(first, first + len(order), dtype=np.int64)[:, None] << SEGMENT_BITS
    chosen = (np.arange(1 << TURNED)[:, None] >> np.arange(TURNED) & 1).astype(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            prints = np.stack([np.asarray(batch.column(1 + i)) for i in range(WORDS)], axis=1) if n else None
            if prints is None:
                continue
            bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, order]
            codes = np.packbits(bits, axis=2, bitorder="little").view(np.uint32).astype(np.int64)
            places = np.frombuffer(b"".join(batch.column(1 + WORDS).to_pylist()), np.uint8)
            places = places.reshape(n, SEGMENTS, TURNED)[:, first:first + len(order)].astype(np.int64)
            turned = (np.int64(1) << places) @ chosen.T
            keys = (codes ^ turned) | number
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(batch.column(0)), keys[0].size)), pa.array(keys.ravel())],
                names=["fp", "v"])
    return emit


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = text_bytes(batch.column(2)), text_bytes(batch.column(3))  # columns 0 and 1 are what is linked
        for cut in pieces([len(a) + len(b) for a, b in zip(left, right)]):
            pairs = zip(shingle_sets(left[cut]), shingle_sets(right[cut]))
            both = [(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)) for a, b in pairs]
            near = pa.array([same >= SIMILAR * (total - same) - 1e-9 for same, total in both])
            own = batch.slice(cut.start, cut.stop - cut.start)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1)], names=["a", "b"]).filter(near)


def _bits(columns: list[str], left: str, right: str) -> Column:
    """In how many bits the columns differ; the names of each side begin with a prefix."""
    return reduce(add, (F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in columns))


def _may_link(left: str, right: str) -> Column:
    """Whether two nodes have near prints, and sets that can be similar enough: each cell with another parity holds a
    shingle that only one of the sets has, and two similar sets have but few of those. No link fails the second test."""
    most = (F.col(f"{left}size") + F.col(f"{right}size")) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9
    return (_bits(_PRINT, left, right) <= MOST_BITS) & (_bits(_PARITY, left, right) <= most)


def _feasible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that may be links, with the number of differing bits of their prints."""
    for side in "ab":
        pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{side}{c}") for c in ["fp", *_COMPARED]]),
                           F.col(side) == F.col(f"{side}fp"))
    return pairs.filter(_may_link("a", "b")).select("a", "b", _bits(_PRINT, "a", "b").alias("bits"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("f")).union(pairs.select(F.col("b").alias("f"))).distinct()


def _texts_of(fps: DataFrame, nodes: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """(fp, text) of the nodes in ``fps`` (f), one text for each."""
    keys = fps.join(nodes.select("fp", "least"), F.col("f") == F.col("fp")).select("fp", "least")
    return stored(docs.join(keys, same_key({"key": "least"})).select("fp", "text").dropDuplicates(["fp"]), rows)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components ra, rb of those pairs of nodes a, b whose shingles have a Jaccard similarity
    of SIMILAR or more."""
    for side in "ab":
        own = texts.select(F.col("fp").alias(f"f{side}"), F.col("text").alias(f"t{side}"))
        pairs = pairs.join(own, F.col(side) == F.col(f"f{side}"))
    return pairs.select("ra", "rb", "ta", "tb").mapInArrow(_compare, "a bigint, b bigint")


def _joined(roots: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """(fp, root) once components are joined by links between their roots."""
    reached = components(links).withColumnRenamed("root", "to")
    return materialise(gathered(roots.join(reached, F.col("root") == F.col("node"), "left").select(
        "fp", F.coalesce("to", "root").alias("root")), rows))


def candidates(nodes: DataFrame, rows: int) -> DataFrame:
    """fp, v, least, n: the members of each bucket of several nodes, its least one and their number."""
    found, many = None, 3 * AT_ONCE if rows <= FEW_NODES else AT_ONCE
    for first in range(0, SEGMENTS, many):
        variants = nodes.filter("fp <> 0").select("fp", *_PRINT, "places").mapInArrow(
            _variants(first, many), "fp bigint, v bigint")
        buckets = variants.groupBy(F.col("v").alias("w")).agg(
            F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        own = stored(variants.join(buckets, F.col("v") == F.col("w")).select("fp", "v", "least", "n"), rows)
        found = own if found is None else found.union(own)
    return found


def _open_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """The pairs a, b of a bucket that may be links between two components, ra and rb. No pair leaves the join before it
    passed _may_link, so a group of texts that are alike, but not enough, gives hardly any, however large it is."""
    own = members.select(F.col("fp").alias("f"), "v").join(roots, F.col("f") == F.col("fp"))
    apart = own.groupBy(F.col("v").alias("w")).agg(
        F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("w")
    rooted = nodes.select("fp", *_COMPARED).join(roots, "fp")
    split = stored(own.join(apart, F.col("v") == F.col("w")).select("fp", "v").join(rooted, "fp"), rows)
    other = split.select(*[F.col(c).alias(f"o{c}") for c in split.columns])
    met = (F.col("v") == F.col("ov")) & (F.col("fp") < F.col("ofp")) & (F.col("root") != F.col("oroot"))
    return split.join(other, met & _may_link("", "o")).select(
        F.col("fp").alias("a"), F.col("ofp").alias("b"), F.col("root").alias("ra"), F.col("oroot").alias("rb")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) for every row: component_id is the least key that can be reached by steps between texts
    whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    The key has to tell rows of other texts apart. Texts with equal sets are one node; those without a word are one, too.
    Two nodes are compared if one of 24 segments of their 256-bit SimHashes agrees up to bits that are among the four
    least certain ones of one of them, if the SimHashes differ in at most MOST_BITS, and if the parity maps of their
    sets do not rule a link out; what is compared, is compared shingle by shingle, so no other texts are joined. Each node is first compared
    with the nearest and the least of the least members of its buckets; then only pairs are left that no links join
    yet, and of those all. No bucket is cut short.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = ", ".join(f"{c} bigint" for c in _COMPARED)
    prints = materialise(docs.mapInArrow(_add_prints, f"key {kind}, fp bigint, {whole}, places binary"))
    rows = prints.count()
    nodes = materialise(gathered(prints.groupBy("fp").agg(
        F.min("key").alias("least"), *[F.min(c).alias(c) for c in _COMPARED], F.min("places").alias("places")), rows))
    members = candidates(nodes, nodes.count())
    stars = members.filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    stars = _feasible(stars, nodes)
    first = stars.groupBy("b").agg(F.min("a").alias("x"), F.min_by("a", F.struct("bits", "a")).alias("y"))
    first = stored(first.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"), rows)
    links = stored(_verified(first.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")),
                             _texts_of(_ends(first), nodes, docs, rows)), rows)
    roots = _joined(nodes.select("fp", F.col("fp").alias("root")), links, rows)
    rest = stored(_open_pairs(members, nodes, roots, rows).join(first, ["a", "b"], "left_anti"), rows)
    if not rest.isEmpty():
        links = stored(_verified(rest, _texts_of(_ends(rest), nodes, docs, rows)), rows)
        roots = _joined(roots, links, rows)
    named = nodes.select("fp", "least").join(roots, "fp")
    ids = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    of_node = materialise(gathered(
        named.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), rows))
    return prints.join(of_node, F.col("fp") == F.col("f")).select(F.col("key").alias(key), "component_id")
