"""Mixing sources to target token weights by entropy balancing.

Document rates ``r`` minimise ``sum(size * r * (log r - 1))``, the relative entropy to taking each
token once, under the token constraints ``sum over a group of size * r = target``.  The solution is
an exponential tilt ``r = exp(sum of the multipliers of the groups a document is in)``; the
multipliers minimise the convex dual, by Newton iterations on the groups' token sums, which Spark
aggregates.  With one constraint column the dual separates and its iterations run beside the sums, a
row a source (``tilted_sources``); with several the small Hessian is solved on the driver (``solve_dual``).

Rates become copies in two steps that depend on nothing but the rows.  In each *cell*, the documents of
one source and size, the whole part of the rate is taken by all and the fraction by as many as
systematic sampling through the source's cells, larger sizes first, gives.  A few exchanges of copies
in single cells then close what is left of each source's gap, until none is made smaller.  Within a cell
copies go to the documents with the least hash of their content.  No document has over three copies.

No table of sources, sizes or rows comes to the driver.  Prefix sums run over ranges of sizes, and a
cell of many rows is cut at ranges of the hash, so no task ranks a hot source or size whole.

Defined results.  A null or empty text has size 0 and takes 0; a very long one counts whole.  A null
source is a source of its own, last in order.  A source without words has target 0.  Repeated rows are
separate documents; among rows equal in all that is hashed any may be taken, and the rows of the result
are the same however the input lies.  An empty table gives an empty result.  Columns other than those
named are not read, whatever they are called.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselon.llm.common import WORD, Scratch, small_table

MAX_COPIES = 3
#: Rows of a cell that one task ranks, on average.
SLICE_ROWS = 20_000
NEWTON_ROUNDS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def group_key(c: Column) -> Column:
    """A never-null key that sorts as the values do, null last."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("w"))


def numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``rank`` from 0 by ``g``: ranges are ranked apart and shifted by the counts of those before."""
    import pyarrow as pa

    s = scratch.write(sources.repartitionByRange("g").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted(s.groupBy("range").agg(F.min("g").alias("low"), F.count("*").alias("n")).collect(), key=lambda r: r["low"])
    shift, at = [], 0
    for r in sizes:  # a row a partition
        shift.append(at)
        at += r["n"]
    shifts = small_table(s.sparkSession, {"range": pa.array([r["range"] for r in sizes], pa.int32()), "shift": pa.array(shift, pa.int64())})
    within = F.row_number().over(Window.partitionBy("range").orderBy("g")) - 1
    return s.withColumn("rank", within).join(F.broadcast(shifts), "range").select(*sources.columns, (F.col("rank") + F.col("shift")).alias("rank"))


def targeted(sources: DataFrame, cap: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to (g, size, rank): weights 1, 2, 3 by rank share all tokens; what exceeds ``cap`` times a size is reshared."""
    weight = (F.col("rank") % 3 + 1).cast("decimal(38,0)")
    size = F.col("size").cast("decimal(38,0)")
    # With the level left / total fixed, a source is capped if its share is above; the level rises until no more are.
    level, count = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level[0]) * weight > F.lit(cap) * size * F.lit(level[1])
        r = sources.agg(
            F.sum(size).alias("all"), F.sum(F.when(over, size)).alias("capped"), F.sum(F.when(~over, weight)).alias("open"), F.count(F.when(over, 1)).alias("n")
        ).first()
        if r["n"] == count or r["open"] is None:
            break
        count = r["n"]
        level = (Decimal(r["all"] - cap * (r["capped"] or 0)), Decimal(r["open"]))
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    over = F.lit(level[0]) * weight > F.lit(cap) * size * F.lit(level[1])
    return sources.withColumn("target", F.when(over | F.lit(r["open"] is None), (F.col("size") * cap).cast("double")).otherwise(weight.cast("double") * float(Fraction(level[0]) / Fraction(level[1]))))


def tilted_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rate``: the exponential of each source's multiplier, by damped Newton steps on its term of the dual."""
    mass = lambda lam: F.col("size") * F.exp(lam)
    step = lambda lam, _: lam + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("target") / mass(lam) - 1.0))
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_ROUNDS)), F.lit(0.0), step)
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.lit(float(MAX_COPIES)), F.exp(lam))).otherwise(0.0)
    # The last bits of the iteration decide nothing, and rates within rounding error of a whole number are that number.
    s = sources.withColumn("rate", F.round(rate, 12))
    return s.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-7, F.round("rate")).otherwise(F.col("rate")))


def solve_dual(cells: DataFrame, columns: list[str], targets: dict[str, dict[str, float]], rounds: int = 40, tolerance: float = 1e-9):
    """Multipliers by (column, value).  ``cells``: one row per combination of the columns, with its tokens in ``size``."""
    import numpy as np

    spark = cells.sparkSession
    names = [(c, v) for c in columns for v in sorted(targets[c]) if targets[c][v] > 0]
    index = {x: i for i, x in enumerate(names)}
    goal = np.array([targets[c][v] for c, v in names])
    lam = np.zeros(len(names))

    def mass(lam):
        d = cells
        for c in columns:
            rows = [(v, float(lam[index[c, v]]), index[c, v]) for cc, v in names if cc == c]
            small = spark.createDataFrame(rows, f"`{c}` string, `_l_{c}` double, `_i_{c}` int")
            d = d.join(small, c)
        eta = sum((F.col(f"_l_{c}") for c in columns), F.lit(0.0))
        return d.withColumn("_m", F.col("size") * F.exp(eta))

    for _ in range(rounds if names else 0):
        # Hessian of the dual: tokens shared by two groups; its diagonal is the current mass, hence the gradient.
        m = mass(lam)
        hess = np.zeros((len(names), len(names))) if len(columns) > 1 else None
        diag = np.zeros(len(names))
        for a in columns:
            for i, v in m.groupBy(f"_i_{a}").agg(F.sum("_m")).collect():
                diag[i] = v
            for b in columns if hess is not None else []:
                if a != b:
                    for i, j, v in m.groupBy(f"_i_{a}", f"_i_{b}").agg(F.sum("_m")).collect():
                        hess[i, j] = v
        grad = goal - diag
        if np.all(np.abs(grad) <= tolerance * np.maximum(goal, 1.0)):
            break
        if hess is None:
            step = grad / np.maximum(diag, 1e-300)
        else:
            np.fill_diagonal(hess, diag)
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        lam = lam + np.clip(step, -1.0, 1.0)
    return {names[i]: float(lam[i]) for i in range(len(names))}


def _before(cells: DataFrame) -> DataFrame:
    """Adds ``before``, the documents of the source in cells of larger sizes: sums over ranges of sizes, then within each."""
    top = F.length(F.bin("size")) - 1
    ranges = F.when(F.col("size") < 16, F.col("size")).otherwise(top * 16 + F.expr("shiftright(size, cast(length(bin(size)) - 5 AS int)) - 16"))
    cells = cells.withColumn("r", ranges.cast("int"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_range = cells.groupBy("g", "r").agg(F.sum("n").alias("n"))
    by_range = by_range.select("g", "r", above(Window.partitionBy("g").orderBy(F.desc("r"))).alias("_above"))
    within = cells.withColumn("_within", above(Window.partitionBy("g", "r").orderBy(F.desc("size"))))
    return within.join(by_range, ["g", "r"]).withColumn("before", F.col("_above") + F.col("_within")).drop("_above", "_within", "r")


def _exchange(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Copies more or less in one cell of each source at a time, as long as that brings the source nearer to its target."""
    while True:
        gaps = cells.groupBy("g").agg((F.max("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("take")))).alias("gap")).filter(F.abs("gap") > 0.5)
        room = F.when(F.col("gap") < 0, F.col("take")).when(F.col("whole") < MAX_COPIES, F.col("n") - F.col("take")).otherwise(0)
        x = cells.join(gaps, "g").withColumn("room", room).filter("room > 0 and size > 0")
        fit = F.floor(F.abs("gap") / F.col("size"))
        x = x.withColumn("m", F.explode(F.array_distinct(F.transform(F.array(F.greatest(fit, F.lit(1)), fit + 1), lambda m: F.least(m, F.col("room"))))))
        x = x.withColumn("left", F.abs(F.abs("gap") - F.col("m") * F.col("size"))).filter("left < abs(gap) - 1e-6")
        best = x.groupBy("g").agg(F.min(F.struct("left", (-F.col("size")).alias("size"), (F.col("m") * F.signum("gap")).cast("long").alias("step"))).alias("p"))
        best = scratch.write(best.select("g", (-F.col("p.size")).alias("size"), "p.step"), "step")
        if best.isEmpty():
            return cells
        new = cells.join(best, ["g", "size"], "left").withColumn("take", F.col("take") + F.coalesce("step", F.lit(0)))
        cells = scratch.write(new.select(cells.columns), "cells")


def mix(rows: DataFrame, row_id: str | None = None, content: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for ``rows`` of doc_id, source, text.

    ``row_id`` names a column to carry along as ``row_id``.  ``content`` are the columns whose hash decides between rows of one cell.
    """
    scratch = Scratch(rows.sparkSession, "mix")
    carried = [] if row_id is None else [F.col(f"`{row_id}`").alias("row_id")]
    base = rows.select(*carried, "doc_id", "source", group_key(F.col("source")).alias("g"), word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in content])).alias("h"))
    base = scratch.write(base, "sizes")
    sizes = scratch.write(base.groupBy("g", "size").agg(F.count("*").alias("n")), "cells")
    sources = numbered(sizes.groupBy("g").agg(F.sum(F.col("size") * F.col("n")).alias("size")), scratch)
    sources = tilted_sources(targeted(scratch.write(sources, "sources"))).select("g", F.col("size").alias("source_size"), "target", "rate")
    cells = _before(sizes).join(sources, "g")
    part = F.col("rate") - F.floor("rate")
    upto = lambda k: F.floor(k * part + 0.5)
    take = upto(F.col("before") + F.col("n")) - upto(F.col("before"))
    cells = scratch.write(cells.select("g", "size", "n", "source_size", "target", "rate", F.floor("rate").cast("long").alias("whole"), take.cast("long").alias("take")), "cells")
    cells = _exchange(cells, scratch)
    scratch.keep_only(base, cells)

    # The rank of each document in its cell, by its hash; cells of many rows are ranked in slices of the hash's range.
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    at = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    d = base.join(cells, ["g", "size"]).withColumns({"slice": F.least(F.floor(at * slices), slices - 1), "slices": slices})
    counts = d.filter("slices > 1").groupBy("g", "size", "slice").agg(F.count("*").alias("k"))
    ahead = F.sum("k").over(Window.partitionBy("g", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "size", "slice", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("g", "size", "slice").orderBy("h", "doc_id"))
    d = d.withColumn("k", rank).join(counts, ["g", "size", "slice"], "left")
    copies = F.col("whole") + (F.col("k") + F.coalesce("ahead", F.lit(0)) <= F.col("take")).cast("long")
    d = d.withColumn("copies", copies)
    return d.select(*["row_id"] * len(carried), "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with.

    Rows are told apart by all their columns; nulls, empty tables and repeated rows as for ``mix``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixed")
    # The rows get an identity to be met again by, which holds because they are written before it is used; it decides nothing.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("_row_id"), whole.alias("_doc")), "rows")
    plan = mix(rows.select("_row_id", "_doc.doc_id", "_doc.source", "_doc.text", "_doc"), "_row_id", ("_doc",))
    # One plan at every size: texts move once, to the copies of their row.
    copies = plan.filter("copies > 0").select(F.col("row_id").alias("_row_id"), "copies")
    taken = rows.join(copies.hint("merge"), "_row_id")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
