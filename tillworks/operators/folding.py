"""Ordered, stateful processing per key, side by side even for a key that holds much of the data.

Some rules cannot be written as an aggregate or a window: whether a movement is accepted depends
on which earlier ones were. Such a fold has to follow the rows of one key in order, but not in
one task. Rows are laid out by range of (key, order), so a very large key is cut into slices of
ordinary size. All slices run at once, those that continue a key from a guessed state. A slice
whose guess differs from the state its predecessor ended in runs again from that state, until all
guesses hold. What slices forget soon, such as a stock that ran out or a line that was removed,
makes most guesses harmless, so a few rounds do; and as every round settles at least one more slice
of each key, the number of rounds never exceeds the number of slices of the largest key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.session import settle, slice_count

_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}

Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


def fold_in_order(
    events: DataFrame,
    key: list[str],
    order_by: list[str],
    start: DataFrame,
    inputs: list[str],
    state: list[T.StructField],
    result: list[T.StructField],
    step: Step,
) -> DataFrame:
    """``events`` with the result columns and the state after each row.

    ``start`` holds the key and the opening state columns; a key it lacks opens with NULLs.
    ``step(input values, state) -> (state, result)`` is called row by row within a key, in the
    total order ``order_by``.
    """
    spark = events.sparkSession
    names = [f.name for f in state]
    place = [*key, "_slice"]
    # written, because a partition id must not change between the uses below
    laid_out = settle(
        events.repartitionByRange(slice_count(events), *key, *order_by).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "fold-slices",
    )

    def run(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(*place).sortWithinPartitions(*place, *order_by)
        schema = T.StructType([*ordered.schema.fields, *result])
        task = _runner(place, inputs, state, result, step)
        return settle(ordered.mapInArrow(task, schema), "fold-run")

    opening = start.select(*key, *names)
    runs = [run(laid_out.join(opening, key, "left"))]

    # keys cut by a slice border; a border cuts one key, so there are at most 2 * slices rows
    spans = laid_out.select(*place).distinct().withColumn(
        "_n", F.count(F.lit(1)).over(W.partitionBy(*key))
    )
    cut = settle(spans.filter("_n > 1").select(*place), "fold-cut")
    at = sorted(tuple(r) for r in cut.dropna().collect())
    if at:
        # small driver-side bookkeeping: (key, slice) -> state it started from, state it ended in
        opened = {
            tuple(r[k] for k in key): tuple(r[n] for n in names)
            for r in opening.join(cut.select(*key).distinct(), key, "left_semi").collect()
        }
        began = {p: opened.get(p[:-1], (None,) * len(names)) for p in at}
        ended = _ends(runs[0], cut, place, names, order_by)
        newest = dict.fromkeys(at, 0)
        schema = T.StructType([cut.schema[c] for c in place] + state)
        while True:
            wrong = [
                (now, ended[before])
                for before, now in zip(at, at[1:])
                if before[:-1] == now[:-1] and ended[before] != began[now]
            ]
            if not wrong:
                break
            again = spark.createDataFrame([p + s for p, s in wrong], schema)
            runs.append(run(laid_out.join(again, place)))
            began.update(wrong)
            ended.update(_ends(runs[-1], again, place, names, order_by))
            newest.update((p, len(runs) - 1) for p, _ in wrong)
        stale = spark.createDataFrame(
            [(*p, r) for p, last in newest.items() for r in range(last)],
            T.StructType([cut.schema[c] for c in place]).add("_run", T.IntegerType()),
        )
        runs = [
            df.join(stale.filter(F.col("_run") == i), place, "left_anti")
            for i, df in enumerate(runs)
        ]
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.drop("_slice")


def _ends(done: DataFrame, cut: DataFrame, place, names, order_by) -> dict[tuple, tuple]:
    """(key, slice) -> state after its last row, for the slices in ``cut``."""
    last = (
        done.join(cut.select(*place), place, "left_semi")
        .groupBy(*place)
        .agg(F.max_by(F.struct(*names), F.struct(*order_by)).alias("s"))
    )
    return {tuple(r[p] for p in place): tuple(r.s) for r in last.collect()}


def _runner(place, inputs, state, result, step):
    names = [f.name for f in state]
    state_types = [_ARROW[f.dataType] for f in state]
    result_types = [_ARROW[f.dataType] for f in result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            places = zip(*[batch.column(c).to_pylist() for c in place])
            events = zip(*[batch.column(c).to_pylist() for c in inputs])
            opens = zip(*[batch.column(c).to_pylist() for c in names])
            states, results = [], []
            for this, event, opening in zip(places, events, opens):
                if this != current:
                    current, held = this, opening
                held, outcome = step(event, held)
                states.append(held)
                results.append(outcome)
            columns = dict(zip(batch.schema.names, batch.columns))
            for values, cols, types in (
                (states, names, state_types),
                (results, [f.name for f in result], result_types),
            ):
                for i, (col, arrow) in enumerate(zip(cols, types)):
                    columns[col] = pa.array([v[i] for v in values], type=arrow)
            yield pa.RecordBatch.from_pydict(columns)

    return run
