"""Mixing sources to target weights by entropy balancing (operator 8).

Each document gets a rate 0…``cap``. Of all rates that meet the word target of every source, those
with the least relative entropy to "take everything once" are min(cap, exp(lambda * size / scale)),
one multiplier per source: exponentially tilted documents. The convex dual is solved by Newton
steps over distributed sums: an iteration joins the multipliers to the distinct (source, size)
counts, sums words and their derivative per source, and moves every multiplier; a step that leaves
its bracket is replaced by halving. Rates become copies by error diffusion: documents of a source
are dealt into blocks of about ``BLOCK`` rows by hash, and inside a block, largest first, each takes
the whole number of copies that brings the words taken so far closest to the words due so far. So
no source, however large, meets in one task, and a block misses its due by about its smallest text.

Everything runs on DataFrame functions. A document's place in a block and its block follow from a
hash of its id and size alone, so reruns agree.

Results: null text has size 0 and takes nothing. A null source is a source of its own, last in the
order. A source without words has target 0. Rows with equal doc_id are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

CAP = 3
BLOCK = 256
WEIGHTS = 3
MAX_ROUNDS = 200
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """Add ``size``, the words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def source_targets(sized: DataFrame, cap: int = CAP, weights: int = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) per source.

    Sources in code point order, null last, weigh 1…``weights`` in turn and share all words; a
    target stops at ``cap`` times its source and the excess is shared again by weight. With sources
    in the order of size per weight, the capped ones are a prefix; the prefix ends where the share
    per weight of what is left fits, which one running sum over the sources shows.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # One row per source from here on: the windows below see the list of sources, not documents.
    weighed = per.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow), fill.rowsBetween(1, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # The level (words per weight) if this source and all before it in the order are capped.
    level = (total - cap * F.sum("source_size").over(upto)) / F.sum("weight").over(after)
    ranked = weighed.withColumns({"level": level, "limit": cap * F.col("source_size") / F.col("weight"), "total": total})
    # Capped while the level before it exceeds its limit; the level in force is that of the last capped one.
    before = F.lag("level", 1).over(fill)
    first = F.col("total") / F.sum("weight").over(Window.partitionBy())
    judged = ranked.withColumn("force", F.coalesce(before, first)).withColumn("capped", F.col("force") > F.col("limit"))
    in_force = F.min(F.when(~F.col("capped"), F.struct(F.col("limit"), F.col("force")))).over(Window.partitionBy())["force"]
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * in_force)
    return judged.select("source", "source_size", "n", target.alias("target"))


def _rate(size: Column, cap: float = CAP) -> Column:
    # exp() of more than ln(cap) is cut anyway, so the exponent is bounded first.
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * size / F.col("scale"), F.lit(50.0))))


def multipliers(sized: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-9) -> DataFrame:
    """(source, lam, scale): the multiplier of each source that meets its target."""
    counts = materialize(sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")))
    scale = counts.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    far = F.lit(None).cast("double")
    state = targets.join(scale, targets["source"].eqNullSafe(scale["source"])).select(
        targets["source"], "target", "scale", (F.col("target") >= cap * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"), far.alias("low"), far.alias("high"), F.lit(False).alias("done"),
    )
    state = materialize(state)
    for _ in range(MAX_ROUNDS):
        tilted = counts.join(state.filter("not done and not full").withColumnRenamed("source", "s"), F.expr("source <=> s"))
        words = F.col("k") * F.col("size") * _rate(F.col("size"), cap)
        free = F.col("lam") * F.col("size") / F.col("scale") < F.log(F.lit(float(cap)))
        sums = tilted.groupBy(F.col("source").alias("of")).agg(
            F.sum(words).alias("taken"), F.sum(F.when(free, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")
        )
        moved = state.join(sums, F.expr("source <=> of"), "left")
        off = F.col("taken") - F.col("target")
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("lam")).otherwise(F.col("high"))
        moved = moved.withColumns({"off": off, "low2": low, "high2": high, "step": F.col("lam") - off / F.nullif("slope", F.lit(0.0))})
        inside = F.coalesce(
            (F.coalesce(F.col("step") > F.col("low2"), F.col("low2").isNull())) & (F.coalesce(F.col("step") < F.col("high2"), F.col("high2").isNull()))
            & (F.abs(F.col("step") - F.col("lam")) < 2 * (F.abs("lam") + 10)), F.lit(False),
        )
        widen = F.when(F.col("off") < 0, F.col("lam") + F.abs("lam") + 4).otherwise(F.col("lam") - F.abs("lam") - 4)
        safe = F.when(F.col("low2").isNull() | F.col("high2").isNull(), widen).otherwise((F.col("low2") + F.col("high2")) / 2)
        done = F.col("done") | F.col("full") | F.coalesce(F.abs("off") <= tolerance * F.col("target") + 1e-6, F.lit(False))
        flat = F.coalesce(F.col("high2") - F.col("low2") < 1e-12 * (1 + F.abs("lam")), F.lit(False))
        state = materialize(moved.select(
            "source", "target", "scale", "full",
            F.when(done, F.col("lam")).when(inside, F.col("step")).otherwise(safe).alias("lam"),
            F.when(done, F.col("low")).otherwise(F.col("low2")).alias("low"), F.when(done, F.col("high")).otherwise(F.col("high2")).alias("high"),
            (done | flat).alias("done"),
        ))
        if not state.filter("not done").take(1):
            break
    else:
        raise RuntimeError(f"the multipliers did not settle in {MAX_ROUNDS} rounds")
    return state.select("source", "scale", "full", "lam")


def mix(docs: DataFrame, key: str = "doc_id", cap: int = CAP, weights: int = WEIGHTS) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken) for every row of ``docs``."""
    sized = materialize(sizes(docs.select(F.col(key).alias("mix_key"), "source", "text")).drop("text"))
    targets = materialize(source_targets(sized, cap, weights))
    tilt = multipliers(sized, targets, cap)
    per = targets.join(tilt.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s")
    rows = sized.join(per.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.coalesce(_rate(F.col("size"), cap), F.lit(0.0)))
    mixed = F.xxhash64(F.col("mix_key").cast("string"), "size", F.lit(8))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = rows.withColumns({"rate": rate, "h": mixed, "block": F.pmod(mixed, blocks)})
    # Largest first; ``due`` and ``got`` are the words due and taken so far.
    item = F.struct((-F.col("size")).alias("minus"), F.col("h"), F.col("mix_key"), F.col("rate"))
    held = dealt.groupBy("source", "source_size", "target", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("got"), F.expr("cast(array() as array<int>)").alias("copies"))

    def take(state: Column, item: Column) -> Column:
        size = -item["minus"]
        due = state["due"] + item["rate"] * size
        copies = F.least(F.lit(cap), F.greatest(F.lit(0), F.round((due - state["got"]) / F.greatest(size, F.lit(1))).cast("int")))
        copies = F.when(size == 0, 0).otherwise(copies)
        return F.struct(due.alias("due"), (state["got"] + copies * size).alias("got"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    taken = held.withColumn("copies", F.aggregate("items", start, take)["copies"])
    paired = taken.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("p"))
    size = -F.col("p.items.minus")
    return paired.select(
        F.col("p.items.mix_key").alias(key), "source", size.alias("size"), "source_size", "target", F.col("p.items.rate").alias("rate"),
        F.col("p.copies").alias("copies"), (size * F.col("p.copies")).alias("taken"),
    )
