"""Segments that follow new reports at the cost of the days they touch.

The state of a data set is four tables, each in folders by version and time chunk: clean reports, one summary per
vessel and chunk, the chain (what a chunk needs from the chunks around it), and segments. New reports change the
chunks they lie in. The summaries of their vessels are chained again, without their reports; chunks whose row in
the chain is another one than before are derived again, and no other report is read.

A manifest names the version of each chunk in each table. It is written last, so a run that is lost half-way
leaves the state before it, and is repeated. Folders of older versions may be removed once nobody reads them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wakeline.operators.clean import deduplicate
from wakeline.operators.segment import SegmentConfig, chain_summaries, chunk_of, chunk_summaries, segments_of_chunks
from wakeline.sources.scratch import materialize

CHUNK = "_chunk"
TABLES = ("points", "summaries", "chain", "segments")
SOURCE = "source"  # manifest rows of what has been added, such as file days


@dataclass(frozen=True)
class Increment:
    """Chunks that new reports lie in, and chunks whose segments were derived again."""

    touched: tuple[int, ...]
    changed: tuple[int, ...]


class SegmentState:
    """Reports and segments of one data set under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, cfg: SegmentConfig = SegmentConfig()) -> None:
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.version, self.held = self._manifest()

    def _manifest(self) -> tuple[int, dict[tuple[str, int], int]]:
        """Last version, and the version of each (table, chunk): a row per table and chunk of time."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0, {}
        rows = self.spark.read.schema("held_table string, chunk long, held long, version int").parquet(f"{self.root}/manifest")
        last = rows.agg(F.max("version")).first()[0] or 0
        return last, {(r["held_table"], r["chunk"]): r["held"] for r in rows.filter(F.col("version") == last).collect()}

    def _write(self, df: DataFrame, table: str, version: int) -> set[int]:
        """Writes chunks of a table as a new version; returns those that have rows."""
        path = f"{self.root}/{table}/version={version}"
        df.hint("rebalance", F.col(CHUNK)).write.mode("overwrite").partitionBy(CHUNK).parquet(path)
        made = self.spark.read.schema(T.StructType([T.StructField(CHUNK, T.LongType())])).parquet(path)
        return {r[CHUNK] for r in made.distinct().collect()}

    def _read(self, table: str, schema: T.StructType, chunks: Iterable[int] | None = None, held: dict | None = None) -> DataFrame:
        held = self.held if held is None else held
        wanted = None if chunks is None else set(chunks)
        paths = [
            f"{self.root}/{table}/version={v}/{CHUNK}={c}"
            for (t, c), v in held.items()
            if t == table and (wanted is None or c in wanted)
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return found.select(*schema.names)

    def _replaced(self, held: dict, table: str, chunks: Iterable[int], made: set[int], version: int) -> dict:
        gone = set(chunks)
        kept = {k: v for k, v in held.items() if k[0] != table or k[1] not in gone}
        return kept | {(table, c): version for c in made}

    def sources(self) -> set[int]:
        """Numbers given to `append` so far, such as ordinals of file days."""
        return {n for t, n in self.held if t == SOURCE}

    def append(self, points: DataFrame, sources: Iterable[int] = ()) -> Increment:
        """Adds clean reports of any time; copies of reports that are there already change nothing.

        Rows without a vessel or a time belong to no chunk and are left out.
        """
        cfg, version = self.cfg, self.version + 1
        new = materialize(
            points.withColumn(CHUNK, chunk_of(cfg)).filter(F.col(CHUNK).isNotNull() & F.col("mmsi").isNotNull()), "new-points"
        )
        touched = sorted(r[CHUNK] for r in new.select(CHUNK).distinct().collect())  # chunks of time, not rows
        held = dict(self.held)
        merged = deduplicate(self._read("points", new.schema, touched).unionByName(new))
        held = self._replaced(held, "points", touched, self._write(merged, "points", version), version)
        of_touched = self._read("points", new.schema, touched, held).drop(CHUNK)

        summaries = chunk_summaries(of_touched, cfg)
        held = self._replaced(held, "summaries", touched, self._write(summaries, "summaries", version), version)

        vessels = new.select("mmsi").distinct()
        all_of_vessels = self._read("summaries", summaries.schema, None, held).join(vessels, "mmsi", "left_semi")
        plan = chain_summaries(all_of_vessels, cfg)
        chain = materialize(plan, "chain")
        before = self._read("chain", plan.schema)
        keys = ["mmsi", CHUNK]
        rest = [c for c in plan.columns if c not in keys]
        was = before.join(vessels, "mmsi", "left_semi").select(*keys, F.struct(*rest).alias("_was"))
        differs = (
            chain.select(*keys, F.struct(*rest).alias("_is"))
            .join(was, keys, "full")
            .filter(~F.col("_is").eqNullSafe(F.col("_was")))
        )
        changed = sorted({r[CHUNK] for r in differs.select(CHUNK).distinct().collect()} | set(touched))
        others = before.filter(F.col(CHUNK).isin(changed)).join(vessels, "mmsi", "left_anti")
        rows = chain.filter(F.col(CHUNK).isin(changed)).unionByName(others.select(*chain.columns))
        held = self._replaced(held, "chain", changed, self._write(rows, "chain", version), version)

        reports = self._read("points", new.schema, changed, held).drop(CHUNK)
        segments = segments_of_chunks(reports, self._read("chain", plan.schema, changed, held), cfg)
        held = self._replaced(
            held, "segments", changed, self._write(segments.withColumn(CHUNK, chunk_of(cfg)), "segments", version), version
        )
        held |= {(SOURCE, n): version for n in sources}
        rows = [(t, c, v) for (t, c), v in sorted(held.items())]
        manifest = self.spark.createDataFrame(rows, "held_table string, chunk long, held long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        self.version, self.held = version, held
        return Increment(tuple(touched), tuple(changed))

    def segments(self) -> DataFrame:
        """All segments; the state must hold reports."""
        versions = {v for (t, _), v in self.held.items() if t == "segments"}
        if not versions:
            raise ValueError("no trajectory is long enough yet")
        paths = [f"{self.root}/segments/version={v}/{CHUNK}={c}" for (t, c), v in self.held.items() if t == "segments"]
        return self.spark.read.parquet(*paths)
