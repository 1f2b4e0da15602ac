"""Ordered scans over keyed rows that do not put a whole key into one task.

``ordered_scan`` cuts each key's order into chunks, runs ordinary windows inside a chunk, reduces each
chunk to one summary row, runs the carry over the summaries, and joins the carry back.  A key that
holds a third of all rows is spread over as many tasks as it has chunks; only its summaries (one row
per chunk) meet in one place.

``fold_sorted`` is for rules where each step depends on the last decision.  Rows are hash-partitioned
by the group, sorted inside the partition and streamed through a rule in Arrow batches, so a
task holds one batch and the rule's own small state, never a group.  Callers first split keys at
points where the state is provably empty, which is what makes the groups small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = "_chunk"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    prev: Sequence[str] = (),
    runs: dict[str, Column] | None = None,
    counts: dict[str, Column] | None = None,
    breaks: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """Add order-dependent columns; ``chunk`` must not decrease along ``order`` within a key.

    ``row_no``          1-based position within the key
    ``prev_<c>``        value of column ``c`` on the previous row
    ``<run>_pos``       length of the run of true flags ending here (0 where the flag is false)
    ``<run>_before``    length of the run of true flags ending on the previous row
    ``<count>``         running count of true flags, or sum of whole numbers, up to here
    ``<break>``         running count of rows for which ``f(previous row, row)`` holds

    Pass only the columns needed afterwards: both the rows and the chunk summaries are made from one
    shuffle of them.
    """
    keep = df.columns
    runs, counts, breaks = runs or {}, counts or {}, breaks or {}
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.struct(*keep)

    flags = [F.coalesce(f, F.lit(False)).alias(f"_flag_{n}") for n, f in runs.items()]
    flags += [F.coalesce(f.cast("bigint"), F.lit(0).cast("bigint")).alias(f"_flag_{n}") for n, f in counts.items()]
    df = df.select("*", F.coalesce(chunk.cast("bigint"), F.lit(-1).cast("bigint")).alias(_CHUNK), *flags)
    cols = [F.row_number().over(local).cast("bigint").alias("_rn")]
    if prev or breaks:
        cols.append(F.lag(whole).over(local).alias("_prev"))
    for name in counts:
        cols.append(F.sum(f"_flag_{name}").over(upto).alias(f"_cnt_{name}"))
    df = df.select("*", *cols)
    cols = []
    for name in runs:
        cols.append(F.max(F.when(~F.col(f"_flag_{name}"), F.col("_rn"))).over(before).alias(f"_gap_{name}"))
    for name, test in breaks.items():
        inner = F.coalesce(test(F.col("_prev"), whole) & F.col("_prev").isNotNull(), F.lit(False))
        cols.append(F.sum(inner.cast("bigint")).over(upto).alias(f"_brk_{name}"))
    df = df.select("*", *cols)

    # one row per (key, chunk); already partitioned by exactly these columns, so no further shuffle
    aggs = [F.max("_rn").alias("_n"), F.max_by(whole, "_rn").alias("_tail")]
    if breaks:
        aggs.append(F.min_by(whole, "_rn").alias("_head"))
    for name in runs:
        aggs.append(F.max(F.when(~F.col(f"_flag_{name}"), F.col("_rn"))).alias(f"_gap_{name}"))
    for name in counts:
        aggs.append(F.sum(f"_flag_{name}").alias(f"_cnt_{name}"))
    for name in breaks:
        aggs.append(F.max(f"_brk_{name}").alias(f"_brk_{name}"))
    # the filter is always true; it keeps whole rows in this branch, so that it can share the rows' shuffle
    chunks = df.groupBy(*keys, _CHUNK).agg(*aggs).filter(F.col("_tail").isNotNull())

    in_order = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    chunks = chunks.withColumns(
        {"_offset": F.coalesce(F.sum("_n").over(earlier), zero), "_before": F.lag("_tail").over(in_order)}
    )
    carried = [F.col("_offset"), F.col("_before")]
    for name in runs:
        carried.append(F.max(F.col("_offset") + F.col(f"_gap_{name}")).over(earlier).alias(f"_gap_in_{name}"))
    for name in counts:
        carried.append(F.coalesce(F.sum(f"_cnt_{name}").over(earlier), zero).alias(f"_cnt_in_{name}"))
    for name, test in breaks.items():
        first = F.coalesce(test(F.col("_before"), F.col("_head")) & F.col("_before").isNotNull(), F.lit(False)).cast("bigint")
        chunks = chunks.withColumn(f"_first_{name}", first)
        total = F.sum(F.col(f"_brk_{name}") + F.col(f"_first_{name}")).over(earlier)
        carried.append((F.coalesce(total, zero) + F.col(f"_first_{name}")).alias(f"_brk_in_{name}"))
    chunks = chunks.select(*keys, _CHUNK, *carried)

    out = df.join(chunks, [*keys, _CHUNK])
    row_no = F.col("_offset") + F.col("_rn")
    result = [row_no.alias("row_no")]
    for c in prev:
        result.append(F.when(F.col("_rn") > 1, F.col("_prev")[c]).otherwise(F.col("_before")[c]).alias(f"prev_{c}"))
    for name in runs:
        gap = F.coalesce(F.col("_offset") + F.col(f"_gap_{name}"), F.col(f"_gap_in_{name}"), zero)
        ended = row_no - 1 - gap
        result.append(ended.alias(f"{name}_before"))
        result.append(F.when(F.col(f"_flag_{name}"), ended + 1).otherwise(zero).alias(f"{name}_pos"))
    for name in counts:
        result.append((F.col(f"_cnt_in_{name}") + F.col(f"_cnt_{name}")).alias(name))
    for name in breaks:
        result.append((F.col(f"_brk_in_{name}") + F.col(f"_brk_{name}")).alias(name))
    return out.select(*keep, *result)


class Rule:
    """A sequential rule over the rows of one group: small state, outputs as tuples."""

    def start(self) -> None:
        """Forget everything; a new group begins."""

    def row(self, *values) -> Iterable[tuple]:
        """Take one row, return output rows."""
        return ()

    def finish(self) -> Iterable[tuple]:
        """The group has ended."""
        return ()


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    rule: Callable[[], Rule],
    schema: str,
) -> DataFrame:
    """Stream each group's rows, in order, through a rule; output rows are the keys plus its tuples.

    ``schema`` is the DDL of the whole output, keys first.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current = rule(), None
        for batch in batches:
            out: list[tuple] = []
            key_rows = zip(*[batch[k].tolist() for k in keys])
            for key, values in zip(key_rows, zip(*[batch[c].tolist() for c in inputs])):
                if key != current:
                    if current is not None:
                        out.extend(current + o for o in machine.finish())
                    machine.start()
                    current = key
                for o in machine.row(*values):
                    out.append(key + o)
            if out:
                yield pd.DataFrame(out, columns=names)
        if current is not None:
            out = [current + o for o in machine.finish()]
            if out:
                yield pd.DataFrame(out, columns=names)

    needed = list(dict.fromkeys(keys + order + inputs))
    parts = df.select(*needed).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return parts.mapInPandas(run, schema)

