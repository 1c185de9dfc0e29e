"""Problem 9: mix sources to target weights of the total size in tokens.

Weighted fair queueing: the documents of a source stand in the order of a hash, and each has a virtual finish time, the
source's tokens up to and including it divided by the source's weight; further passes over a source go on from its total.
The mixture ends at the time V at which the sources together reach the budget, in one global order; a document that V falls
into is taken if at least half of it lies before V, so a source is never further from its share than half a document.
Cumulative tokens come from sums of hash slots, so a source with a third of all documents is spread over thousands of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspan.llm.tokens import VOCABULARY, token_count
from vocspan.session import cut

SLOTS = 4096
#: Copies of one document that are laid out at once.
COPIES = 10_000


def virtual_end(totals: dict[str, int], weights: dict[str, float], repeats: dict[str, int], budget: float | None = None) -> float:
    """The virtual time at which sum(min(weight * V, total * repeats)) reaches the budget.

    Without a budget: the largest V at which every source that has tokens still gives its full share. With one: the
    time when it is reached, or when every source is used up.
    """
    have = {s: totals.get(s, 0) * repeats[s] for s in weights if weights[s] > 0 and totals.get(s, 0) * repeats[s] > 0}
    if not have:
        return 0.0
    ends = sorted((have[s] / weights[s], s) for s in have)
    if budget is None:
        return ends[0][0]
    done, active, at = 0.0, sum(weights[s] for s in have), 0.0
    for end, s in ends:
        if done + active * (end - at) >= budget:
            return at + (budget - done) / active
        done += active * (end - at)
        active -= weights[s]
        at = end
    return ends[-1][0]


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, path: str = VOCABULARY, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, source, pass_no, n_tokens, virtual_finish, in global order. shares: source, target_share, actual_share,
    n_documents, n_tokens, available_tokens, passes (how often the source is used, as a fraction) of every target.
    Documents without a source, a target or a text stay out; a source without tokens gets nothing and is reported with share
    0. Weights are taken relative to their sum, NULL or negative weights and repeats below 1 count as 0. targets is a small table of one
    row per source (a repeated source counts once, with its largest weight).
    """
    listed = targets.filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).collect()
    weights = {t["source"]: max(0.0, t["w"] or 0.0) for t in listed}
    repeats = {t["source"]: max(0, t["r"] or 0) for t in listed}
    whole = sum(weights.values()) or 1.0
    weights = {s: w / whole for s, w in weights.items()}
    spark = documents.sparkSession
    named = documents.filter(F.col("source").isin(list(weights)) & F.col("text").isNotNull())
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    # Repeated rows are one row with a number from here on, so copies of one document are no hot slot.
    sized = named.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"), h.alias("h")).groupBy("doc_id", "source", "n_tokens", "h").agg(F.count(F.lit(1)).alias("copies"))
    sized = cut(sized).withColumn("slot", F.pmod(F.shiftright("h", 52), F.lit(SLOTS)))
    slots = sized.groupBy("source", "slot").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    totals = {r["source"]: r["t"] for r in slots.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    end = virtual_end(totals, weights, repeats, budget)
    plan = [(s, float(weights[s]), int(totals.get(s, 0)), int(repeats[s])) for s in sorted(weights)]
    small = spark.createDataFrame(plan, "source string, w double, total long, r int")
    over = Window.partitionBy("source").orderBy("slot")
    before = slots.withColumn("before", F.sum("t").over(over) - F.col("t")).drop("t")
    inside = Window.partitionBy("source", "slot").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum(F.col("n_tokens") * F.col("copies")).over(inside)).join(before, ["source", "slot"]).join(F.broadcast(small.filter("w > 0 and total > 0 and r > 0")), "source")
    placed = placed.withColumn("upto", F.col("upto") + F.col("before") - F.col("n_tokens") * F.col("copies"))
    # Copies are laid out again in two steps, so that no row holds an array of all of them.
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).withColumn("copy", F.explode(F.sequence(F.col("k") * COPIES, F.least((F.col("k") + 1) * COPIES, F.col("copies")) - 1)))
    placed = placed.withColumn("upto", F.col("upto") + (F.col("copy") + 1) * F.col("n_tokens"))
    passes = F.least(F.col("r"), (F.floor(F.lit(end) * F.col("w") / F.col("total")) + 1).cast("int"))
    each = placed.withColumn("pass_no", F.explode(F.when(passes >= 1, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>"))))
    finish = ((F.col("pass_no") - 1) * F.col("total") + F.col("upto")) / F.col("w")
    middle = F.col("virtual_finish") - F.col("n_tokens") / (2 * F.col("w"))
    # The last document of a source that is used up may be held back by the rounding of doubles.
    taken = each.withColumn("virtual_finish", finish).filter(middle <= end * (1 + 1e-12)).select("doc_id", "source", "pass_no", "n_tokens", "virtual_finish")
    got = taken.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    shares = small.join(F.broadcast(got), "source", "left").fillna(0, ["n_documents", "n_tokens"])
    all_tokens = F.greatest(F.sum("n_tokens").over(Window.partitionBy()), F.lit(1))
    shares = shares.select(
        "source", F.col("w").alias("target_share"), (F.col("n_tokens") / all_tokens).alias("actual_share"), "n_documents", "n_tokens", F.col("total").alias("available_tokens"),
        F.when(F.col("total") > 0, F.col("n_tokens") / F.col("total")).otherwise(0.0).alias("passes"),
    )
    return taken.orderBy("virtual_finish", "source", "doc_id"), shares
