"""Mixing sources to target weights by entropy balancing, with Spark expressions only.

Each document gets the rate that stays closest (in relative entropy, every document counting once) to taking it once, under the
constraints that the words taken from its source meet the source's target and that no rate exceeds a cap. The dual is
convex: the rate of a document of s words is min(cap, exp(multiplier of its source * s)). Newton steps, kept inside a bracket,
solve for all multipliers at once. They run over the counts of documents by source and size, which hold all that the dual depends
on. Rates are then rounded into whole copies along falling size, so that the rounding errors of a source cancel, and what is left is
given to single documents.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, Latest, materialize, ordered_positions

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, and no target exceeds so many times its source's size.
CAP = 3
STEPS, CLOSE = 60, 1e-4
#: Largest number of rows of one source and size that one task ranks.
RANKED_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source``, ``size`` and ``n``.

    Sources in order of code points, nulls last, get the weights in turn and share the sum of all sizes. Targets above the cap
    times the source's size stop there, and their excess goes to the others by weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = ordered_positions(sources, [F.col("source").asc_nulls_last()], name="sources").drop("before")
    turn = F.pmod("pos", F.lit(len(weights)))
    weight = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(turn == i, w).otherwise(weight)
    placed = materialize(placed.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).cast("double").alias("most")), "sources")
    total = float(placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    share = 0.0  # words for each unit of weight among the sources below their caps; it only rises
    while True:
        stopped = F.col("weight") * share > F.col("most")
        held, free = placed.agg(F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / free if free else share
        if new <= share * (1 + 1e-12):
            break
        share = new
    return placed.select("source", "source_size", F.least(F.col("weight") * share, F.col("most")).alias("target"))


def _rate(multiplier: Column, scaled: Column, cap: int) -> Column:
    return F.exp(F.least(multiplier * scaled, F.lit(math.log(cap))))


def balance(cells: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """The multiplier of each source: ``source``, ``source_size``, ``target``, ``scale``, ``multiplier``.

    cells: ``source``, ``size``, ``n``. ``scale`` is the mean size that sizes are divided by. Each step is one aggregation of the
    cells; the state, a row for each source, is stored in place of the one before. All rates lie on one side of the target's share of
    the source at the multiplier that gives this share to the least size, and on the other side at the one for the largest size: they bracket
    the solution. The first guess gives it to the mean size. A step that would leave the bracket halves it.
    """
    weighted = F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))
    facts = cells.filter("size > 0").groupBy("source").agg(weighted.alias("scale"), F.min("size").alias("least"), F.max("size").alias("most"))
    state = wanted.join(facts, wanted["source"].eqNullSafe(facts["source"]), "left").drop(facts["source"])
    full = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    share = F.when(full, math.log(cap)).otherwise(F.log(F.col("target") / F.col("source_size")))
    ends = [share * F.col("scale") / F.col(c) for c in ("least", "most")]
    known = F.col("scale").isNotNull()
    state = state.select(
        "source", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.when(known, F.when(full, ends[0]).otherwise(share)).otherwise(0.0).alias("multiplier"),
        F.when(known, F.least(*ends)).otherwise(0.0).alias("low"), F.when(known, F.greatest(*ends)).otherwise(0.0).alias("high"), (full | ~known).alias("done"),
    )
    kept, top = Latest("balance"), math.log(cap)
    state = kept.put(state)
    for _ in range(STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        carried = [c for c in state.columns if c != "source"]
        at = cells.join(state, cells["source"].eqNullSafe(state["source"])).drop(state["source"])
        scaled = F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * _rate(F.col("multiplier"), scaled, cap)
        slope = F.when(F.col("multiplier") * scaled < top, words * scaled).otherwise(0.0)
        step = at.groupBy("source").agg(F.sum(words).alias("taken"), F.sum(slope).alias("slope"), *(F.first(c).alias(c) for c in carried))
        over = F.col("taken") - F.col("target")
        low = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - F.when(F.col("slope") > 0, over / F.col("slope"))
        moved = F.when(F.coalesce((newton > low) & (newton < high), F.lit(False)), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(over) <= F.greatest(F.lit(0.25), CLOSE * F.col("target")))
        new = {"multiplier": F.when(done, F.col("multiplier")).otherwise(moved), "low": low, "high": high, "done": done}
        state = kept.put(step.select("source", *((new[c].alias(c) if c in new else F.col(c)) for c in carried)))
    else:
        left = state.filter(~F.col("done")).count()
        if left:
            warnings.warn(f"{left} sources are not balanced after {STEPS} steps", stacklevel=2)
    return state.select("source", "source_size", "target", "scale", "multiplier")


def copies_by_cell(cells: DataFrame, state: DataFrame, cap: int = CAP, rounds: int = 4) -> DataFrame:
    """``source``, ``size``, ``n``, ``copies`` (of all documents of the cell together), ``rate``, ``source_size``, ``target``.

    Rates are rounded along falling size. In each round what a source still misses, or has too much, goes to copies of its largest size
    that fits into it. All windows lie over the cells of a source, a row for each of its different sizes, and share one shuffle.
    """
    at = cells.join(state, cells["source"].eqNullSafe(state["source"])).drop(state["source"])
    at = at.withColumn("rate", _rate(F.col("multiplier"), F.col("size") / F.col("scale"), cap))
    whole = Window.partitionBy("source")
    along = whole.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(along))
    last = F.floor(F.col("upto") + 0.5 + 1e-9)
    first = F.floor(F.col("upto") - F.col("n") * F.col("rate") + 0.5 + 1e-9)
    at = at.select("source", "size", "n", "rate", "source_size", "target", F.least(F.greatest(last - first, F.lit(0)), cap * F.col("n")).cast("long").alias("copies"))
    for _ in range(rounds):
        at = at.withColumn("error", F.col("target") - F.sum(F.col("size") * F.col("copies")).over(whole))
        room = F.when(F.col("error") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("error")) & (room > 0)
        at = at.withColumn("best", F.max(F.when(fits, F.col("size"))).over(whole))
        change = F.least(F.floor(F.abs("error") / F.col("size")), room) * F.signum("error")
        at = at.withColumn("copies", (F.col("copies") + F.when(F.col("size") == F.col("best"), change).otherwise(0)).cast("long")).drop("error", "best")
    return materialize(at, "copies")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (copies times size) of every row.

    A null text has no words; a null source is a source of its own; rows of one source and size are told apart by their hashed keys
    only, so that reruns agree; repeated rows count each; rows without words get one copy; an empty table gives no rows.
    """
    sizes = materialize(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    cells = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    state = balance(cells, targets(cells, weights, cap), cap)
    given = copies_by_cell(cells, state, cap)
    given = given.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("copies")))
    same = [sizes["source"].eqNullSafe(given["source"]), sizes["size"] == given["size"]]
    rows = sizes.join(given, same).drop(given["source"], given["size"])
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    rows = rows.withColumn("part", F.pmod(F.col("hash"), F.ceil(F.col("n") / RANKED_ROWS))).withColumn("more", F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n"))
    # a cell's spare copies go to its parts in proportion, and in a part to the first rows by hash: no task ranks a whole large cell
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.max("more").alias("more"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("m").over(along)
    parts = parts.withColumn("end", end)
    spare = F.floor(F.col("end") * F.col("more") / F.col("n")) - F.floor((F.col("end") - F.col("m")) * F.col("more") / F.col("n"))
    parts = parts.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("part").alias("_part"), spare.alias("spare"))
    inside = Window.partitionBy("source", "size", "part").orderBy("hash", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    ranked = ranked.join(parts, ranked["source"].eqNullSafe(parts["_source"]) & (ranked["size"] == parts["_size"]) & (ranked["part"] == parts["_part"]))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)
    out = ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
