"""Operator 7: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with their token
mass.  Raking scales the mass of the cells in turn to the target marginals of
source, language and topic until all three hold.  A cell's fitted mass over its
own mass, times one constant, is the probability with which its documents are
kept; the constant makes the expected tokens kept the asked share of all tokens,
with probabilities capped at 1.  A document is kept if a uniform number made of
the MD5 of its id is below its probability, so the sample is the same in every
run and on every cluster.

Only DataFrame operations run here: every raking step is a grouped sum of the
small cell table and a join back to it, stored after each sweep; the driver sees
a few numbers per sweep.  Documents meet the cell table in a join that Spark
broadcasts if the table is small, and splits by AQE if not; texts are never
shuffled.

Topics are rules on the text, first match first; ``prose`` where none matches.

Cases: null source, language or text count as the empty string; documents
without words have no mass and share their cell's probability (the common
constant if the whole cell has none); repeated rows are kept or dropped
together; a null doc_id is an empty id; values without a target get none of the
mass and are dropped, and a target for values that do not occur is shared out
over the others; an empty table gives an empty result; clashing columns of
``docs`` are replaced (``topic, n_tokens, weight, probability, kept``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DIMS = ("source", "lang", "topic")
#: (topic, pattern): rules of the default topics.
TOPICS = (("legal", r"(Licensed|licensed|Copyright|copyright|LICENSED)"), ("records", r" \| "),
          ("contact", r"(@[a-z]|\+[0-9])"))
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(doc_id: Column) -> Column:
    """52 bits of the MD5 of the id, in [0, 1)."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with its cell as struct ``_cell`` and ``n_tokens``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cell = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                    F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                    topic_of(text).alias("topic"))
    return docs.withColumns({"_cell": cell, "n_tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension in proportion to its token mass to a power:
    below 1 flattens, 0 makes all values equal."""
    mass = cells.groupBy(dim).agg(F.sum("n").cast("double").alias("mass")).where("mass > 0")
    return mass.select(dim, F.pow("mass", F.lit(power)).alias("target"))


def rake(scratch: Scratch, cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9,
         max_sweeps: int = 100) -> DataFrame:
    """``cells`` with the fitted mass ``w``: marginals follow ``targets`` (each
    ``dim, target``, in any unit) and the total is that of ``n``."""
    total = cells.agg(F.sum("n").cast("double")).first()[0] or 0.0
    scaled = {}
    for dim, target in targets.items():
        there = scratch.store(target.join(cells.where("n > 0").select(dim).distinct(), dim)
                              .groupBy(dim).agg(F.sum("target").alias("target")), f"target-{dim}")
        unit = there.agg(F.sum("target")).first()[0] or 1.0
        scaled[dim] = there.select(dim, (F.col("target") * total / unit).alias("target"))
    state, before = cells.withColumn("w", F.col("n").cast("double")), None
    for dim, target in scaled.items():
        state = state.join(target.withColumnRenamed("target", f"_{dim}"), dim, "left")
    for sweep in range(max_sweeps):
        off = F.lit(0.0)
        for dim in scaled:
            sums = state.groupBy(dim).agg(F.sum("w").alias("s"))
            ratio = F.when(F.col("s") > 0, F.coalesce(f"_{dim}", F.lit(0.0)) / F.col("s")).otherwise(0.0)
            state = state.join(sums, dim).withColumn("r", ratio).withColumn("w", F.col("w") * F.col("r")).withColumn(
                "off", F.greatest(off if dim == next(iter(scaled)) else F.col("off"),
                                  F.when(F.col("w") > 0, F.abs(F.col("r") - 1)).otherwise(0.0))).drop("r", "s")
        state = scratch.store(state, f"sweep-{sweep}")
        far = state.agg(F.max("off")).first()[0]
        if before:
            scratch.drop(before)
        before, state = f"sweep-{sweep}", state.drop("off")
        if far is None or far < tolerance:
            break
    return state.drop(*(f"_{dim}" for dim in scaled))


def calibrate(fitted: DataFrame, share: float) -> DataFrame:
    """``weight`` (fitted over own mass) and ``probability`` min(1, c * weight),
    with c such that the expected tokens kept are ``share`` of all."""
    cells = fitted.withColumn("weight", F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(1.0))
    budget = share * (cells.agg(F.sum("n")).first()[0] or 0)
    c = share
    while True:
        # c only grows, and with it the set of cells at probability 1: ends after at most that many rounds
        full, rest = cells.agg(F.sum(F.when(F.col("weight") * c >= 1, F.col("n")).otherwise(0)),
                               F.sum(F.when(F.col("weight") * c < 1, F.col("w")).otherwise(0.0))).first()
        new = (budget - full) / rest if rest else c
        if not rest or new <= c * (1 + 1e-12):
            break
        c = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(float(c))))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
        share: float = 0.5) -> DataFrame:
    """All rows of ``docs`` with ``topic, n_tokens, weight, probability, kept``.

    ``targets``: per dimension a table ``(dim, target)``; dimensions that it
    does not name are tempered by ``powers``."""
    scratch = Scratch(docs.sparkSession, "mix")
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.7} | (powers or {})
    clash = [c for c in ("topic", "n_tokens", "weight", "probability", "kept", "_cell") if c in docs.columns]
    told = features(docs.drop(*clash))
    cells = scratch.store(told.groupBy("_cell").agg(F.sum("n_tokens").alias("n")).select("_cell.*", "n"), "cells")
    wanted = {d: (targets or {}).get(d) for d in DIMS}
    fitted = rake(scratch, cells, {d: tempered(cells, d, powers[d]) if t is None else t for d, t in wanted.items()})
    rates = scratch.store(calibrate(fitted, share).select(
        F.struct(*DIMS).alias("_cell"), "weight", "probability"), "rates")
    return (told.join(rates, "_cell").withColumn("topic", F.col("_cell.topic"))
            .withColumn("kept", uniform(F.col("doc_id")) < F.col("probability")).drop("_cell"))
