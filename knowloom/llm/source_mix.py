"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. Whole epochs over a source come first; what is left of its budget goes to the
documents with the smallest exponential keys ``-ln(u) / quality``, up to the point where their sizes add up to it.
``u`` is a hash of the document's id, so a rerun draws the same documents.

Nothing is sorted within a source. Keys fall into narrow steps of their logarithm; sizes add up per source and step
with map-side combine, and only the one step in which a source's budget runs out is put in order. No step holds more
than ``1 / (e * STEPS)`` of the keys of one quality, whatever the size of the source. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from knowloom.llm.shared import staged

#: Relative weights of the sources in their order, repeating; all budgets together as a share of all words; and the most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Steps of the keys per factor of e, and steps that are summed as one first.
STEPS, RUN = 4096, 256
WORD = r"[^\x20\x09-\x0D]+"


def _earlier(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def words_of(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letters_share(text: Column) -> Column:
    """A simple quality weight: the share of a text's characters that are letters or not ASCII, 0.05 at least."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number strictly between 0 and 1 that follows from the id: 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (one row per ``source``, with ``source_size``) with ``target``.

    Sources take the weights in code point order, null last. Their budgets share ``share`` of all words by weight, none
    over ``most`` times its own words. What a full source leaves goes to the others by weight: sources fill up in the
    order of words per weight, and the first that does not fill sets the level for all after it.
    One row per source is put in order at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * float(most)
    filling = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    every = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    rows = sizes.withColumn("weight", given).withColumn("level", level).withColumn("full", full)
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(every)["level"]
    return rows.withColumn("settled", settled).select("source", "source_size", F.least("full", F.coalesce(F.col("settled") * F.col("weight"), F.col("full"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 13, quality: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every row of ``docs``.

    ``size`` counts the words of ``text``. ``taken`` is the number of words the mix takes from the row: its size times
    the whole epochs of its source, once more if it is drawn. Documents are taken whole; the one in which the budget
    runs out is taken if more than half of it still fits, so a source misses its target by half a document at most.
    ``quality`` is a positive column of ``docs`` (default :func:`letters_share`): of two documents the one with the
    higher weight is the likelier to be drawn.

    Null and empty texts have size 0 and give nothing. Null is a source of its own. Rows without a ``doc_id`` share one
    draw, as do rows that repeat an id; those are then ordered by quality and size, and equal rows are drawn one after
    another. Weights that are null or not positive count as the smallest. Other columns are ignored; an empty table
    gives no rows.
    """
    weight = F.col("text").cast("string") if quality is None else quality
    weight = letters_share(weight) if quality is None else F.greatest(F.lit(1e-9), F.coalesce(quality.cast("double"), F.lit(1e-9)))
    key = -F.log(draw(F.col("doc_id"), seed)) / weight
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.col("text").cast("string")).alias("size"), key.alias("key"))
    rows = staged(rows.withColumn("step", F.floor(F.log("key") * STEPS)), "sized")

    steps = rows.groupBy("source", "step").agg(F.sum("size").alias("words"))
    sources = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Running sums over a source's steps: within runs of steps, and over the few runs.
    steps = steps.withColumn("run", F.floor(F.col("step") / RUN))
    runs = steps.groupBy("source", "run").agg(F.sum("words").alias("words"))
    runs = runs.select(F.col("source").alias("of"), F.col("run").alias("at"), F.coalesce(F.sum("words").over(_earlier("run", "source")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("words").over(_earlier("step", "source", "run")), F.lit(0))
    filled = steps.withColumn("inside", inside).join(runs, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at"))).select("source", "step", (F.col("before") + F.col("inside")).alias("before"))
    last = filled.alias("f").join(sources.alias("s"), F.col("f.source").eqNullSafe(F.col("s.source")) & (F.col("before") <= F.col("rest")))
    last = last.groupBy("f.source").agg(F.max(F.struct("step", "before")).alias("at"))
    plan = staged(sources.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source"))).select("s.*", "at.step", "at.before"), "plan")

    known = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    known = known.select("r.doc_id", "r.source", "r.size", "r.key", "p.source_size", "p.target", "p.epochs", "p.rest", "p.before", (F.col("r.step") - F.col("p.step")).alias("past"))
    clear = known.where("past <> 0").withColumn("drawn", F.col("past") < 0)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    edge = known.where("past = 0").withColumn("drawn", reached < F.col("rest"))
    taken = F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
