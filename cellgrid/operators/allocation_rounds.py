"""The best hourly plan, exact, in rounds over the edge table.

Every source carries a label, a lower bound on the number of hand-overs that separate it
from a source with spare capacity left. In a round every case places its open need at its
neighbour with the lowest label, every overfull source gives the surplus back, first to the
cases with the best alternative, and raises its label to one above that alternative. When an
hour has no source at some label, sources above it cannot reach free capacity any more and
are closed. An hour is done when nothing is given back; what is then uncovered has only
closed neighbours, so the covered total is the largest possible: the deficits of the other cases and the
spare of the closed neighbours make a cut of just that size, which is given as proof.

The windows run over one case or one source in one hour, at most eight rows each, whatever
the size of the grid or of an hour. Hours that are done leave the loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import AMOUNT_TOLERANCE
from ..session import materialise

CLOSED = 1 << 30
# Surpluses below this are rounding noise of the sums.
_NOISE = AMOUNT_TOLERANCE / 1000
# Rounds between two writes: a round of an hour that is done changes nothing, so a few at a time
# cost less than the write they save.
ROUNDS_A_WRITE = 4


def _start(edges: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("target_datetime", "congested_cell").orderBy("pos")) == 1
    return edges.select(
        "target_datetime", "congested_cell", "source_cell", "spare", "deficit",
        F.lit(0.0).alias("flow"), F.lit(0).alias("label"),
        F.when(first, F.col("deficit")).otherwise(0.0).alias("returned"),
    )


def _round(state: DataFrame) -> DataFrame:
    case = Window.partitionBy("target_datetime", "congested_cell")
    choices = F.sort_array(F.collect_list(F.struct("label", "source_cell")).over(case))
    asked = state.withColumns({"need": F.sum("returned").over(case), "choices": choices})
    best = F.col("choices")[0]
    chosen = (F.col("source_cell") == best["source_cell"]) & (best["label"] < CLOSED)
    next_best = F.coalesce(F.get("choices", F.lit(1))["label"], F.lit(CLOSED))
    placed = asked.withColumns(
        {
            "other": F.when(F.col("source_cell") == best["source_cell"], next_best).otherwise(best["label"]),
            "flow": F.col("flow") + F.when(chosen, F.col("need")).otherwise(0.0),
        }
    ).drop("need", "choices", "returned")

    source = Window.partitionBy("target_datetime", "source_cell")
    before = source.orderBy("other", "congested_cell").rowsBetween(Window.unboundedPreceding, -1)
    weighed = placed.withColumns(
        {
            "surplus": F.sum("flow").over(source) - F.col("spare"),
            "given_before": F.coalesce(F.sum("flow").over(before), F.lit(0.0)),
            "raised": F.min(F.when(F.col("flow") > 0, F.col("other"))).over(source) + 1,
        }
    )
    overfull = F.col("surplus") > _NOISE
    back = F.least(F.greatest(F.col("surplus") - F.col("given_before"), F.lit(0.0)), F.col("flow"))
    settled = weighed.withColumn("returned", F.when(overfull, back).otherwise(0.0)).select(
        "target_datetime", "congested_cell", "source_cell", "spare", "deficit",
        (F.col("flow") - F.col("returned")).alias("flow"),
        F.when(overfull, F.least(F.greatest("label", "raised"), F.lit(CLOSED))).otherwise(F.col("label")).alias("label"),
        "returned",
    )
    return settled


def _hours(state: DataFrame) -> DataFrame:
    """Per hour: whether something was given back, and the lowest label that no source of it has."""
    labels = state.groupBy("target_datetime", "label").agg(F.max("returned").alias("returned"))
    # As many labels as rounds at most; the first missing one ends the run 0, 1, 2, ...
    rank = F.row_number().over(Window.partitionBy("target_datetime").orderBy("label")) - 1
    return labels.withColumn("rank", rank).groupBy("target_datetime").agg(
        (F.max("returned") > 0).alias("under_way"),
        F.coalesce(F.max(F.when((F.col("label") == F.col("rank")) & (F.col("label") < CLOSED), F.col("label"))) + 1, F.lit(0)).alias("gap"),
    )


def _with_gaps_closed(state: DataFrame, hours: DataFrame) -> DataFrame:
    joined = state.join(hours, "target_datetime")
    label = F.when(F.col("label") >= F.col("gap"), F.lit(CLOSED)).otherwise(F.col("label"))
    return joined.withColumn("label", label).drop("gap")


def _final_state(edges: DataFrame) -> DataFrame:
    """Flows and labels of a best plan, every edge once.

    One write per step of ``ROUNDS_A_WRITE`` rounds, so plans stay short and a lost executor costs
    one step at most. Labels only rise and end at ``CLOSED``, so the loop ends by its own rule.
    """
    state = materialise(_start(edges), "round")
    done = []
    while True:
        step = state
        for _ in range(ROUNDS_A_WRITE):
            step = _round(step)
        state = materialise(step, "round")
        # One row an hour, staged so that the planner can broadcast it by its real size.
        hours = materialise(_hours(state), "hours")
        placed = _with_gaps_closed(state, hours)
        done.append(placed.filter("NOT under_way").drop("under_way"))
        if hours.filter("under_way").isEmpty():
            return reduce(DataFrame.unionByName, done)
        state = placed.filter("under_way").drop("under_way")


def solve(edges: DataFrame) -> DataFrame:
    """A best plan: rows (kind, target_datetime, congested_cell, source_cell, amount).

    Kind ``move``: an amount from a source to a case. Kind ``cut``, as proof: the deficits of the cases with
    an open neighbour, and the spare of the neighbours of all other cases; no plan moves more than their sum.
    """
    state = materialise(_final_state(edges), "plan-state")
    moves = state.filter(F.col("flow") > AMOUNT_TOLERANCE).select(
        F.lit("move").alias("kind"), "target_datetime", "congested_cell", "source_cell", F.col("flow").alias("amount")
    )
    case = Window.partitionBy("target_datetime", "congested_cell")
    sided = state.withColumn("shut", F.min("label").over(case) >= CLOSED)
    nobody = F.lit(None).cast("long")
    by_case = sided.filter("NOT shut").groupBy("target_datetime", "congested_cell").agg(F.max("deficit").alias("amount"))
    by_source = sided.filter("shut").groupBy("target_datetime", "source_cell").agg(F.max("spare").alias("amount"))
    return moves.unionByName(
        by_case.select(F.lit("cut").alias("kind"), "target_datetime", "congested_cell", nobody.alias("source_cell"), "amount")
    ).unionByName(
        by_source.select(F.lit("cut").alias("kind"), "target_datetime", nobody.alias("congested_cell"), "source_cell", "amount")
    )
