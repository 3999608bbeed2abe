"""Training curves of many runs: loss per epoch, early stopping, learning-rate halvings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.plans.pointers import next_below, on_chain
from runsight.plans.running import Running, between, hot_keys, running, since_reset
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

RUN = "run_id"
#: Candidates of a run that are gone through as one list.
FOLDED = 1024

# Settings of the training loop.
STOP_PATIENCE = 5
PLATEAU_PATIENCE = 3
PLATEAU_FACTOR = 0.5
LEARNING_RATE = 1e-3
PLATEAU_THRESHOLD = 1e-4  # an improvement smaller than this share does not count
SMALLEST_CHANGE = 1e-8  # rates stop falling once a step would be no larger than this


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None))


def early_stop(epochs: DataFrame, patience: int = STOP_PATIENCE) -> DataFrame:
    """Epoch log (run_id, epoch, val_loss, val_accuracy): when patience ran out, and the best epoch until then.

    A missing loss is no improvement. A run without any loss has no best epoch, but it stops like the others.
    """
    hot = hot_keys(epochs, [RUN])
    seen = between(running(epochs, [RUN], "epoch", [Running("_low", "min", _number("val_loss"), before=True)], hot=hot), hot)
    loss = _number("val_loss")
    improved = F.coalesce(loss < F.coalesce(F.col("_low"), F.lit(float("inf"))), F.lit(False))
    waits = materialize(since_reset(seen.withColumn("_new", improved), [RUN], "epoch", "waited", F.lit(1), F.col("_new"), hot=hot))
    stops = materialize(waits.groupBy(RUN).agg(F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stopped_at")))
    bests = waits.where("_new").join(broadcast_if_small(stops, stored=True), RUN)
    until = bests.where(F.col("stopped_at").isNull() | (F.col("epoch") < F.col("stopped_at")))
    best = until.groupBy(RUN).agg(
        F.max("epoch").alias("best_epoch"),
        F.max_by("val_loss", "epoch").alias("best_val_loss"),
        F.max_by("val_accuracy", "epoch").alias("best_accuracy"),
    )
    return stops.join(best, RUN, "left").select(RUN, "stopped_at", "best_epoch", "best_val_loss", "best_accuracy")


def epoch_averages(batches: DataFrame) -> DataFrame:
    """Batch log (run_id, epoch, loss, correct, total) to loss and accuracy per epoch."""
    seen = F.greatest(F.sum("total"), F.lit(1))
    return batches.groupBy(RUN, "epoch").agg(
        (F.sum(F.col("loss") * F.col("total")) / seen).alias("loss"), (F.sum("correct") / seen).alias("accuracy")
    )


def _gaps(candidates: DataFrame, threshold: float) -> DataFrame:
    """(run_id, after, until): from each best loss to the next, 0 standing for the start. ``candidates``: run_id, position, val_loss."""
    counts = materialize(candidates.groupBy(RUN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select(RUN))
    if counts.isEmpty():
        return _folded(candidates, threshold)
    long = broadcast_if_small(counts, stored=True)
    return _folded(candidates.join(long, RUN, "left_anti"), threshold).unionByName(_chained(candidates.join(long, RUN, "left_semi"), threshold))


def _folded(candidates: DataFrame, threshold: float) -> DataFrame:
    """Runs with few candidates: each is one list, gone through in order."""
    lists = candidates.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct("position", "val_loss"))).alias("rows"))
    none = F.array().cast("array<struct<after: bigint, until: bigint>>")
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).cast("long").alias("at"), none.alias("gaps"))

    def step(state: Column, row: Column) -> Column:
        gap = F.struct(state["at"].alias("after"), row["position"].alias("until"))
        best = F.struct(row["val_loss"].alias("best"), row["position"].alias("at"), F.concat(state["gaps"], F.array(gap)).alias("gaps"))
        return F.when(row["val_loss"] < state["best"] * (1 - threshold), best).otherwise(state)

    return lists.select(RUN, F.explode(F.aggregate("rows", start, step)["gaps"]).alias("gap")).select(RUN, "gap.*")


def _chained(candidates: DataFrame, threshold: float) -> DataFrame:
    """Runs of any length: the bests are the rows on the chain of pointers from the first candidate."""
    placed = materialize(running(candidates, [RUN], "position", [Running("place", "count", F.lit(True), before=True)]))
    rows = placed.select(RUN, "place", F.col("val_loss").alias("value"), (F.col("val_loss") * (1 - threshold)).alias("limit"))
    pointers = materialize(next_below(rows, [RUN]))
    bests = pointers.join(on_chain(pointers, [RUN]), [RUN, "place"])
    of = lambda place, position: placed.select(RUN, F.col("place").alias(place), F.col("position").alias(position))
    between_bests = bests.where("target IS NOT NULL").join(of("place", "after"), [RUN, "place"]).join(of("target", "until"), [RUN, "target"])
    first = placed.where("place = 0").select(RUN, F.lit(0).cast("long").alias("after"), F.col("position").alias("until"))
    return first.unionByName(between_bests.select(RUN, "after", "until"))


def plateau_lr(
    epochs: DataFrame,
    patience: int = PLATEAU_PATIENCE,
    factor: float = PLATEAU_FACTOR,
    start: float = LEARNING_RATE,
    threshold: float = PLATEAU_THRESHOLD,
) -> DataFrame:
    """Epochs at which the learning rate falls, from the loss curve: (run_id, epoch, reduction, learning_rate).

    The rate falls after every ``patience + 1`` epochs in a row that do not beat the best loss by the threshold.
    Which losses count as such a best depends on the one before; only rows below all earlier losses can be one, or any row once losses are negative.
    Of a run with up to ``FOLDED`` such rows they are folded in order, as one list. Longer ones are chains of pointers, from each row to the first one that beats it.
    The falls between two bests follow by arithmetic.
    """
    seen = running(
        epochs.select(RUN, "epoch", "val_loss"),
        [RUN],
        "epoch",
        [
            Running("position", "count", F.lit(True)),
            Running("_low", "min", _number("val_loss"), before=True),
        ],
    )
    seen = materialize(seen)
    loss = F.col("val_loss")
    candidate = F.col("_low").isNull() | (F.col("_low") < 0) | (loss < F.col("_low"))
    finite = _number("val_loss").isNotNull() & (loss < float("inf"))
    candidates = seen.where(finite & candidate).select(RUN, "position", loss.cast("double").alias("val_loss"))
    gaps = materialize(_gaps(candidates, threshold))
    ends = seen.groupBy(RUN).agg((F.max("position") + 1).alias("until"))
    last = gaps.groupBy(RUN).agg(F.max("until").alias("after"))
    tails = ends.join(last, RUN, "left").select(RUN, F.coalesce("after", F.lit(0)).alias("after"), "until")
    falls = F.floor((F.col("until") - 1 - F.col("after")) / (patience + 1)).cast("long")
    counted = materialize(gaps.unionByName(tails).withColumn("falls", falls).where(F.col("falls") > 0))
    numbered = running(counted, [RUN], "after", [Running("earlier", "sum", F.col("falls"), before=True)])

    most, rate = 0, start
    while rate * (1 - factor) > SMALLEST_CHANGE:
        most, rate = most + 1, rate * factor
    events = (
        numbered.where(F.col("earlier") < most)
        .withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("falls"), most - F.col("earlier")))))
        .select(
            RUN,
            (F.col("after") + F.col("step") * (patience + 1)).alias("position"),
            (F.col("earlier") + F.col("step")).alias("reduction"),
        )
    )
    return events.join(seen.select(RUN, "position", "epoch"), [RUN, "position"]).select(
        RUN, "epoch", "reduction", (F.lit(start) * F.pow(F.lit(factor), F.col("reduction"))).alias("learning_rate")
    )
