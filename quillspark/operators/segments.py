"""An index of immutable segments: what changes is added as one more segment, and segments are merged by term.

A segment is a folder with ``docs`` and ``postings`` like those of ``postings.write_index``, and ``replaced``: the
(segment, id) of older rows that it takes the place of. A row is live unless a listed segment replaces it. The segments
that count are listed in a numbered file; of two writers that built on the same list one is refused and builds again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark import fixed_values as fixed
from quillspark.operators import postings
from quillspark.sinks.commit_log import put_if_absent

_REPLACED = "segment string, id string"
MOST_TRIES = 20
#: The end of the names of segments that hold no papers.
_WITHOUT = "-removed"


class SegmentedIndex:
    """``buckets`` is the number of term folders in each segment and has to stay the same."""

    def __init__(self, spark: SparkSession, root: str, rules=fixed.TOPIC_RULES, buckets: int = postings.BUCKETS):
        self.spark, self.root, self.rules, self.buckets = spark, root.rstrip("/"), rules, buckets

    def _listed(self) -> tuple[int, list[str]]:
        """The number of the newest list, 0 without one, and its segments, oldest first."""
        try:
            lists = self.spark.read.schema("number bigint, segments array<string>").json(f"{self.root}/lists")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        newest = lists.orderBy(F.desc("number")).first()
        return (newest.number, list(newest.segments)) if newest else (0, [])

    def segments(self) -> list[str]:
        return self._listed()[1]

    def _read(self, names: Sequence[str], part: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        # One path for each segment; the term folders below it stay partitions.
        frames = [reader.option("basePath", f"{self.root}/segments/{n}/{part}").parquet(f"{self.root}/segments/{n}/{part}")
                  for n in names]
        rows = frames[0]
        for other in frames[1:]:
            rows = rows.unionByName(other)
        return rows

    def _live(self, names: Sequence[str], part: str, listed: Sequence[str]) -> DataFrame:
        rows = self._read([n for n in names if not n.endswith(_WITHOUT)], part)
        gone = self._read(listed, "replaced", _REPLACED)
        return rows.join(gone, ["segment", "id"], "left_anti")

    def _change(self, build: Callable[[str, list[str]], list[str]], ending: str = "") -> str:
        for _ in range(MOST_TRIES):
            number, listed = self._listed()
            name = f"{number + 1:08d}-{uuid.uuid4().hex}{ending}"
            after = build(name, listed)
            row = json.dumps({"number": number + 1, "segments": after}).encode() + b"\n"
            if put_if_absent(self.spark, f"{self.root}/lists", f"{number + 1:08d}.json", row):
                return name
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def _replace(self, ids: DataFrame, listed: list[str], folder: str) -> None:
        """Write which live rows of the listed segments have one of these ids."""
        if listed:
            old = self._live(listed, "docs", listed).select("segment", "id").join(ids, "id", "left_semi")
            old = old.select("segment", "id")
        else:
            old = self.spark.createDataFrame([], _REPLACED)
        old.write.parquet(f"{folder}/replaced")

    def add(self, papers: DataFrame) -> str:
        """A segment of these papers, which replace older ones with their ids. Only these papers are tokenised and
        written; of the others, the ids are read. Ids have to be unique."""
        def build(name: str, listed: list[str]) -> list[str]:
            folder = f"{self.root}/segments/{name}"
            postings.write_index(papers, folder, self.rules, self.buckets, segment=name)
            self._replace(self.spark.read.parquet(f"{folder}/docs").select("id"), listed, folder)
            return [*listed, name]
        return self._change(build)

    def remove(self, ids: DataFrame) -> str:
        """A segment without papers that takes the given ids (column id) out of the index."""
        def build(name: str, listed: list[str]) -> list[str]:
            self._replace(ids.select("id").distinct(), listed, f"{self.root}/segments/{name}")
            return [*listed, name]
        return self._change(build, _WITHOUT)

    def merge(self, names: Sequence[str] | None = None) -> str:
        """One segment in the place of several (all by default): their live rows, by term; the dead ones are gone."""
        def build(name: str, listed: list[str]) -> list[str]:
            chosen = [n for n in listed if names is None or n in names]
            if names is not None and len(chosen) < len(set(names)) or not chosen:
                raise ValueError("a segment to be merged is not listed")
            folder = f"{self.root}/segments/{name}"
            docs, rows = (self._live(chosen, part, listed).withColumn("segment", F.lit(name)) for part in ("docs", "postings"))
            docs.write.parquet(f"{folder}/docs")
            postings.write_postings(rows, folder)
            # What the chosen ones replace in others still counts.
            self._read(chosen, "replaced", _REPLACED).where(~F.col("segment").isin(chosen)).write.parquet(f"{folder}/replaced")
            at = listed.index(chosen[-1])
            return [n for n in listed[:at] if n not in chosen] + [name] + listed[at + 1:]
        return self._change(build)

    def index(self) -> postings.Index:
        """The live rows of all listed segments; postings.search gives the ranking of an index written at once."""
        listed = self.segments()
        if not listed:
            raise ValueError("the index is empty")
        return postings.Index(self._live(listed, "docs", listed).drop("segment"),
                              self._live(listed, "postings", listed).drop("segment"), self.buckets)
