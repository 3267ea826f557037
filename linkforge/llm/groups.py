"""Streaming over groups of rows, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Applies ``fn`` to the rows of each group, sorted by ``order``; rows arrive as dicts.

    One sorted stream a task instead of one Python call with its own batch a group: thousands of small
    groups cost little. Groups must be bounded by the caller.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at, out = None, []

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at and held:
                    out += fn(held)
                    held = []
                    if len(out) >= 10_000:
                        yield pack(out)
                        out = []
                at = key
                held.append(row)
        if held:
            out += fn(held)
        if out:
            yield pack(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): ``node, comp``, comp being the smallest node.

    Labels pass along edges and then jump (label of the label), so a chain of n nodes takes about log n
    rounds. Every round is written to the shared folder; only a count of changes comes to the driver.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stages.put(both)
    label = stages.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        step = stages.put(step)
        jump = step.join(step.select(F.col("node").alias("n2"), F.col("comp").alias("c2")), F.col("comp") == F.col("n2"), "left")
        new = stages.put(jump.select("node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        changed = new.where("was <> comp").count()
        stages.free(step, label)
        label = new.select("node", "comp")
        label._stage_path = new._stage_path
        if not changed:
            stages.free(both)
            return label
