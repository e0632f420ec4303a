"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, in a shuffled (hash) order and repeated pass by pass, get the virtual
finish time: cumulative tokens of the source divided by its target weight. Taking documents by
finish time serves all sources in proportion to their weights; the queue is range-sorted by
finish time and truncated at the total budget. The budget is the largest at which no source
with documents has to repeat more than max_repeats times.

Cumulative sums run inside hash or finish-time buckets with pre-aggregated offsets, so a source
with a third of all rows is no single task; the number of buckets grows with the data.

Draws that cannot be reached are not made. When time v has passed, a source with share s has
given at least s v tokens less its longest document, until it is used up, which no source is
before the budget. So beyond v = budget + (budget (1 - sum of shares) + sum of longest) / s, with
s the share of the source that lasts longest, the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import TOKENIZER, with_tokens
from tidewatch.operators.prefix import buckets_for, hash_bucket, running_sum
from tidewatch.session import cut

def _targets(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.filter((F.col("target_share") > 0) & F.col("mix_name").isNotNull() & F.col("source").isNotNull())
    t = t.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return t.withColumn("max_repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)))


def _queues(documents: DataFrame, mix_targets: DataFrame, seed: int, tokenizer: str, budget: int | None) -> tuple[DataFrame, int]:
    sized = cut(with_tokens(documents, tokenizer).filter((F.col("tokens") > 0) & F.col("source").isNotNull()))
    buckets = buckets_for(sized.count())
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.max("tokens").alias("longest"))
    plan = _targets(mix_targets).join(totals, "source")
    lasts = F.col("source_tokens") * F.col("max_repeats") / F.col("target_share")
    limit = plan.groupBy("mix_name").agg(F.floor(F.min(lasts)).alias("budget"), F.max_by("target_share", lasts).alias("last_share"), F.sum("target_share").alias("shares"), F.sum("longest").alias("slack"))
    if budget is not None:
        limit = limit.withColumn("budget", F.least("budget", F.lit(budget)))
    end = F.col("budget") + (F.col("budget") * F.greatest(1 - F.col("shares"), F.lit(0.0)) + F.col("slack") + 1) / F.col("last_share")
    plan = plan.join(limit.withColumn("end", end), "mix_name").drop("longest", "last_share", "shares", "slack")

    shuffled = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("b", hash_bucket(F.col("h"), buckets))
    queued = running_sum(shuffled, ["source"], "b", ["h", "doc_id"], "tokens", "upto").select("doc_id", "source", "tokens", "upto")
    room = F.col("end") * F.col("target_share") - F.col("upto")
    times = F.least(F.col("max_repeats").cast("long"), F.floor(room / F.col("source_tokens")) + 1)
    drawn = queued.join(plan, "source").filter(room >= 0).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    finish = (F.col("upto") + (F.col("repeat_no") - 1) * F.col("source_tokens")) / F.col("target_share")
    return drawn.withColumn("virtual_finish", finish), buckets


def mixture(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER, budget: int | None = None) -> DataFrame:
    """mix_name, source, doc_id, repeat_no, tokens, virtual_finish, upto_tokens: the drawn documents.

    ``upto_tokens`` is the mix's running total in queue order; it never exceeds the budget, which
    is ``budget`` tokens or what the scarcest source allows, whichever is less.
    Documents without tokens or source are never drawn. A target source without documents has
    no part and sets no limit (its share is reported as 0). Targets without positive share are
    left out; a null max_repeats counts as 1. Empty tables give an empty result.
    """
    q, buckets = _queues(documents, mix_targets, seed, tokenizer, budget)
    q = q.withColumn("b", F.floor(F.col("virtual_finish") * buckets / F.greatest("end", F.lit(1))).cast("int"))
    q = running_sum(q, ["mix_name"], "b", ["virtual_finish", "source", "repeat_no", "doc_id"], "tokens", "upto_tokens")
    return q.filter(F.col("upto_tokens") <= F.col("budget")).select("mix_name", "source", "doc_id", "repeat_no", "tokens", "virtual_finish", "upto_tokens")


def shares(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER, budget: int | None = None) -> DataFrame:
    """Target and reached share of each source in each mix, with tokens, draws and most repeats."""
    got = mixture(documents, mix_targets, seed, tokenizer, budget).groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("draws"), F.max("repeat_no").alias("repeats"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    out = _targets(mix_targets).join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "draws", "repeats")]
    return out.select("mix_name", "source", "target_share", "max_repeats", *zero, F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"))
