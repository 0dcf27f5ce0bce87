"""Exact interpolated quantiles in one pass over the table and three over its stored numbers.

The table is read once, its wanted columns stored as numbers. The first scan of those builds a
mergeable quantile sketch of every column, which brackets each wanted rank between two values. The
second counts the rows below and up to the brackets, exactly. The third keeps the values inside the
brackets, well under a hundredth of the rows, with their counts; ranks are then found in that small
table by histograms that narrow down on one value. The number of scans does not depend on the
values, and no task ever holds or sorts a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.session import drop_stored, stored

BUCKETS = 4096
#: Size of the sketch, the share of the rows by which it may misplace a rank, and steps of its grid.
SKETCH, ERROR, GRID = 2000, 0.004, 512


def _number(name: str) -> Column:
    """The column as a double; NaN counts as missing, infinities as the largest numbers."""
    x = F.col(name).cast("double")
    edge = 1.7976931348623157e308
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(-edge)), F.lit(edge)))


def _bracket(grid: Sequence[float], n: int, k: int) -> tuple[float, float]:
    """Two values of the grid between which ranks k and k + 1 of n lie."""
    slack = n * ERROR + 2
    first = math.floor((k - slack) / n * GRID) - 1
    last = math.ceil((k + 1 + slack) / n * GRID) + 1
    return grid[max(first, 0)], grid[min(last, GRID)]


def _narrowed(cells: DataFrame, spans: dict, buckets: int) -> dict:
    """Every open span becomes its bucket that holds the rank.

    ``spans``: (column, rank) to (low, high, rows below it); ``cells``: ``i``, ``x``, ``n``. Ranks in
    one span share its histogram of at most ``buckets`` rows.
    """
    spark = cells.sparkSession
    held = sorted({(i, *span) for (i, _), span in spans.items() if span[0] < span[1]})
    number = {span: s for s, span in enumerate(held)}
    cuts = spark.createDataFrame([(s, *span[:3]) for span, s in number.items()], "s int, j int, low double, high double")
    share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    counts = (
        cells.join(F.broadcast(cuts), (F.col("i") == F.col("j")) & F.col("x").between(F.col("low"), F.col("high")))
        .groupBy("s", bucket.alias("b"))
        .agg(F.sum("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    )
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    wanted = spark.createDataFrame(
        [(number[i, *span], i, k, k - span[2]) for (i, k), span in spans.items() if span[0] < span[1]],
        "s int, j int, k bigint, inside bigint",
    )
    found = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .join(F.broadcast(wanted), "s")
        .filter((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside")))
        .select("j", "k", "least", "most", (F.col("upto") - F.col("n")).alias("below"))
    )
    return spans | {
        (r.j, r.k): (r.least, r.most, spans[r.j, r.k][2] + r.below) for r in found.collect()
    }


def _bracketed(df: DataFrame, ends: Sequence, ranks: set[tuple[int, int]]) -> dict:
    """(low, high, rows below low) of every rank, checked by one exact count of the table.

    Should a bracket miss its rank, which the sketch's error allows once in hundreds, the whole range
    of its column stands in.
    """
    spans = {(i, k): _bracket(ends[i]["grid"], ends[i]["n"], k) for i, k in ranks}
    edges = sorted({(i, *span) for (i, _), span in spans.items()})
    counted = df.agg(
        *(
            F.struct(
                F.count_if(F.col(f"c{i}") < low).alias("below"),
                F.count_if(F.col(f"c{i}") <= high).alias("upto"),
            ).alias(f"e{e}")
            for e, (i, low, high) in enumerate(edges)
        )
    ).first()
    around = {edge: counted[e] for e, edge in enumerate(edges)}
    out = {}
    for (i, k), span in spans.items():
        rows = around[i, *span]
        fits = rows["below"] <= k < rows["upto"]
        out[i, k] = (*span, rows["below"]) if fits else (ends[i]["low"], ends[i]["high"], 0)
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], buckets: int = BUCKETS
) -> DataFrame:
    """(column, prob, value), linearly interpolated; columns without values are left out."""
    spark = df.sparkSession
    numbers = stored(df.select(*(_number(c).alias(f"c{i}") for i, c in enumerate(columns))), "quantile-columns")
    grid = F.lit([g / GRID for g in range(GRID + 1)])
    ends = numbers.agg(
        *(
            F.struct(
                F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"),
                F.when(
                    F.count(c) > 0,
                    F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, F.lit(SKETCH)), grid),
                ).alias("grid"),
            ).alias(c)
            for c in numbers.columns
        )
    ).first()
    places = {
        (i, q): q * (ends[i]["n"] - 1) for i in range(len(columns)) if ends[i]["n"] for q in probs
    }
    last = {i: ends[i]["n"] - 1 for i, _ in places}
    ranks = {
        (i, k) for (i, _), at in places.items() for k in (math.floor(at), min(math.floor(at) + 1, last[i]))
    }
    spans = _bracketed(numbers, ends, ranks) if ranks else {}
    if any(low < high for low, high, _ in spans.values()):
        inside: dict[int, Column] = {}
        for i, low, high in sorted({(i, *span[:2]) for (i, _), span in spans.items() if span[0] < span[1]}):
            within = F.col(f"c{i}").between(low, high)
            inside[i] = inside[i] | within if i in inside else within
        cells = F.array(*(F.when(w, F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("x"))) for i, w in inside.items()))
        kept = numbers.select(F.explode(F.array_compact(cells)).alias("cell")).groupBy("cell.i", "cell.x")
        table = stored(kept.agg(F.count(F.lit(1)).alias("n")), "quantile-cells")
        while any(low < high for low, high, _ in spans.values()):
            spans = _narrowed(table, spans, buckets)
        drop_stored(table)
    drop_stored(numbers)
    out = []
    for (i, q), at in places.items():
        k = math.floor(at)
        low, high = spans[i, k][0], spans[i, min(k + 1, last[i])][0]
        out.append((columns[i], float(q), low + (high - low) * (at - k)))
    return spark.createDataFrame(out, "column string, prob double, value double")
