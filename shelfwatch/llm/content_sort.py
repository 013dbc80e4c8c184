"""Exact dedup by sorting whole contents.

Rows are range-partitioned between sampled splitters on (first bytes, 64-bit hash, id), each partition is sorted
by (first bytes, hash, whole content, id) with Spark's external sort, and every row's content is compared in full
with its neighbour's. The id in the splitters lets a large group of copies run over as many partitions as it needs;
only the hash groups that touch a partition's border ("edges") are merged afterwards, again by full content, from
one row per run. What the driver samples for the splitters is a fixed number of bytes a row, however long texts are.

Null contents count as empty. Of equal contents the row with the largest id stays (a null id is the smallest); of
rows that repeat both id and content exactly one stays. An empty table gives an empty result. Input columns may
have any names: helper columns get fresh ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.llm.common import blank_null, staged, tag, tidy

#: Bytes of the content that take part in the splitters; ties go on to the hash and the id.
HEAD_BYTES = 64


def _changes(column: pa.Array, before) -> np.ndarray:
    """True where a value differs from the one before it; ``before`` stands before the first."""
    out = np.ones(len(column), bool)
    out[0] = column[0].as_py() != before
    out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


class _Runs:
    """Walks one sorted partition; holds back rows until their hash group is complete."""

    def __init__(self, columns: list[str], names: dict[str, str], survivors: bool, schema: pa.Schema):
        self.columns, self.names, self.survivors, self.schema = columns, names, survivors, schema
        self.part = TaskContext.get().partitionId()
        self.run = self.group = -1
        self.before: tuple = (None, None, None)
        self.held: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        head, mark, content = (batch.column(self.names[n]) for n in ("head", "mark", "content"))
        new_group = _changes(head, self.before[0]) | _changes(mark, self.before[1])
        new_run = new_group | _changes(content, self.before[2])
        run, group = self.run + np.cumsum(new_run), self.group + np.cumsum(new_group)
        self.run, self.group = int(run[-1]), int(group[-1])
        self.before = tuple(c[-1].as_py() for c in (head, mark, content))
        ends = np.append(new_run[1:], True)
        shown = pa.array(ends & ((group == 0) | (group == self.group)))
        content = pc.if_else(shown, content, pa.scalar(None, content.type))
        rows = pa.table([batch.column(c) for c in self.columns], names=self.columns)
        weight = np.ones(len(run), np.int64)
        if self.survivors:  # one row of each run is enough
            at = np.flatnonzero(ends)
            weight = np.diff(np.append(-1, at))
            rows, content, run, group = rows.take(at), content.take(at), run[at], group[at]
        self.held.append((rows, content, run, group, weight))
        if self.held[0][3][0] < self.group:
            yield from self.flush(self.group)

    def flush(self, below: int | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of the hash groups before ``below``; all of them, the last as an edge, without it."""
        if not self.held:
            return
        rows = pa.concat_tables([h[0] for h in self.held])
        content = pa.chunked_array([h[1] for h in self.held])
        run, group, weight = (np.concatenate([h[i] for h in self.held]) for i in (2, 3, 4))
        cut = len(run) if below is None else int(np.searchsorted(group, below))
        self.held = [] if below is None else [(rows[cut:], content[cut:].combine_chunks(), run[cut:], group[cut:], weight[cut:])]
        rows, content, run, group, weight = rows[:cut], content[:cut], run[:cut], group[:cut], weight[:cut]
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        last = np.append(starts[1:], len(run)) - 1
        size = np.add.reduceat(weight, starts)
        at = last if self.survivors else np.arange(len(run))
        of = np.arange(len(starts)) if self.survivors else np.repeat(np.arange(len(starts)), last - starts + 1)
        edge = (group[at] == 0) | ((below is None) & (group[at] == self.group))
        ends = at == last[of]
        text = pc.if_else(pa.array(edge & ends), content.take(at), pa.scalar(None, content.type))
        out = [*(rows.column(c).take(at) for c in self.columns), pa.array(np.full(len(at), self.part, np.int32)), pa.array(run[at]),
               rows.column(self.names["id"]).take(last[of]), pa.array(size[of]), pa.array(ends), pa.array(edge), text]
        table = pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=self.schema.names).cast(self.schema)
        yield from table.to_batches(max_chunksize=4096)


def marked(docs: DataFrame, columns: list[str], *, id_col: str, content: Column, survivors: bool) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of the rows with ``run``'s surviving id (``keep``), size (``n``) and whether the row stays (``kept``).

    ``survivors`` leaves out rows that do not stay. The result has been written to the shared folder, so partition
    numbers stay as they were when the runs were found.
    """
    names = {n: tag(n) for n in ("id", "head", "mark", "content", "part", "run", "keep", "n", "last", "edge", "text", "wins")}
    rows = docs.select(*columns, F.col(id_col).alias(names["id"]), content.alias(names["content"]))
    rows = rows.withColumns({names["head"]: F.substring(F.encode(names["content"], "UTF-8"), 1, HEAD_BYTES), names["mark"]: F.xxhash64(names["content"])})
    order = [names["head"], names["mark"]]
    rows = rows.repartitionByRange(*order, names["id"]).sortWithinPartitions(*order, names["content"], names["id"])
    kept = [*columns, *([names["id"]] if names["id"] not in columns else [])]
    fields = [*(rows.schema[c] for c in kept), T.StructField(names["part"], T.IntegerType()), T.StructField(names["run"], T.LongType()),
              T.StructField(names["keep"], rows.schema[names["id"]].dataType), T.StructField(names["n"], T.LongType()),
              T.StructField(names["last"], T.BooleanType()), T.StructField(names["edge"], T.BooleanType()), T.StructField(names["text"], T.StringType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(kept, names, survivors, arrow)
        for batch in batches:
            yield from runs.add(batch)
        yield from runs.flush()

    found = staged(rows.mapInArrow(tidy(walk), schema), "content-runs")
    same = Window.partitionBy(names["text"])
    merged = found.where(F.col(names["text"]).isNotNull()).select(
        names["part"], names["run"], F.max(names["keep"]).over(same).alias(names["keep"]), F.sum(names["n"]).over(same).alias(names["n"]),
        (F.max(F.struct(names["keep"], names["part"], names["run"])).over(same) == F.struct(names["keep"], names["part"], names["run"])).alias(names["wins"]))
    inner = found.where(~F.col(names["edge"])).drop(names["part"], names["run"], names["text"], names["edge"])
    edge = found.where(names["edge"]).drop(names["keep"], names["n"], names["text"], names["edge"]).join(merged, [names["part"], names["run"]])
    edge = edge.withColumn(names["last"], F.col(names["last"]) & F.col(names["wins"])).select(inner.columns)
    return inner.unionByName(edge), {"keep": names["keep"], "n": names["n"], "kept": names["last"]}


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared (by default the text itself).
    """
    content = blank_null((normalise or (lambda c: c))(F.col(text_col)))
    digest = tag("sha")
    found, names = marked(docs.withColumn(digest, F.sha2(content, 256)), [id_col, digest], id_col=id_col, content=content, survivors=False)
    return found.select(id_col, F.col(names["keep"]).alias("keep_id"), F.col(names["n"]).alias("group_size"),
                        F.col(names["kept"]).alias("kept"), F.col(digest).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; each group's text travels once."""
    content = blank_null((normalise or (lambda c: c))(F.col(text_col)))
    found, names = marked(docs, docs.columns, id_col=id_col, content=content, survivors=True)
    return found.where(names["kept"]).select(docs.columns)
