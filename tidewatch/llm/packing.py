"""Filling fixed-capacity containers: best-two-fit on the size histogram.

Best-two-fit: fill a bin greedily with the largest items that fit; then, if there is room
left, replace the bin's smallest item by two unpacked items that fit the expanded gap more
tightly. Whether an item fits depends on its size alone, so the packing is computed on the
histogram of sizes: at most ``capacity`` rows a budget, whatever the number of documents. A
bin's pattern stays the outcome as long as the counts allow it, so it is applied to all those
bins at once; this gives what packing bin by bin would.

Items then find their bin by equi join: the rank of an item among those of its size (ranked
in hash buckets, so that a size with a third of all items is no single task) falls into one
slot range of a pattern. Both sides state the block of ranks they lie in, so the join reads few
ranges an item and a size with a third of all items is spread over its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import TOKENIZER, with_tokens
from tidewatch.operators.prefix import buckets_for, hash_bucket, running_sum
from tidewatch.session import cut

#: Ranks of one size that meet in one join key.
BLOCK = 4096


def best_two(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Positions of two available items (maybe of one size) with the largest sum up to ``room``; ``sizes`` ascending."""
    n = int(np.searchsorted(sizes, room, side="left"))
    at = np.flatnonzero(counts[:n] > 0)
    if not len(at):
        return None
    s = sizes[at]
    mate = np.searchsorted(s, room - s, side="right") - 1
    # An item is no mate for itself unless there are two of its size: take the next smaller one.
    alone = (mate == np.arange(len(s))) & (counts[at] < 2)
    mate = np.where(alone, mate - 1, mate)
    total = np.where(mate >= 0, s + s[np.maximum(mate, 0)], -1)
    i = int(total.argmax())
    return (int(at[i]), int(at[mate[i]])) if total[i] > 0 else None


def pack(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {size: items of it in each bin}) of every pattern, in packing order.

    ``sizes`` ascending, distinct, in 1..capacity.
    """
    counts = counts.astype(np.int64).copy()
    out = []
    top = len(sizes) - 1
    while True:
        while top >= 0 and counts[top] == 0:
            top -= 1
        if top < 0:
            return out
        used: dict[int, int] = {}

        def take(i: int, k: int, used: dict[int, int] = used) -> None:
            used[i] = used.get(i, 0) + k
            counts[i] -= k

        gap, i = capacity, top
        while gap > 0:
            i = min(i, int(np.searchsorted(sizes, gap, side="right")) - 1)
            live = np.flatnonzero(counts[: i + 1])
            if i < 0 or not len(live):
                break
            i = int(live[-1])
            k = min(int(counts[i]), gap // int(sizes[i]))
            take(i, k)
            gap -= k * int(sizes[i])
        if gap > 0:
            least = min(used)
            pair = best_two(sizes, counts, gap + int(sizes[least]))
            if pair and sizes[pair[0]] + sizes[pair[1]] > sizes[least]:
                take(least, -1)
                for p in pair:
                    take(p, 1)
        used = {i: k for i, k in used.items() if k}
        more = min(int(counts[i]) // k for i, k in used.items())
        for i, k in used.items():
            counts[i] -= more * k
        out.append((1 + more, {int(sizes[i]): k for i, k in used.items()}))


def _slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slot ranges of one budget from its histogram (bounded by its capacity)."""
    pdf = pdf.sort_values("tokens")
    first_rank: dict[int, int] = {}
    rows, bins = [], 0
    for n, used in pack(pdf["tokens"].to_numpy(), pdf["items"].to_numpy(), int(pdf["capacity_tokens"].iloc[0])):
        filled = sum(s * k for s, k in used.items())
        for s, k in used.items():
            a = first_rank.get(s, 0)
            rows.append((s, a, a + n * k, k, bins, filled))
            first_rank[s] = a + n * k
        bins += n
    out = pd.DataFrame(rows, columns=["tokens", "rank_from", "rank_to", "per_bin", "first_bin", "prompt_tokens"])
    return out.assign(budget_name=pdf["budget_name"].iloc[0])


def pieces(sized: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """Items of each budget: texts whole; one larger than the capacity in full pieces and a rest."""
    b = F.inline(F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(int(c)).cast("long").alias("capacity_tokens")) for n, c in budgets]))
    per = sized.filter(F.col("tokens") > 0).select("doc_id", F.col("tokens").alias("total"), b)
    n = F.ceil(F.col("total") / F.col("capacity_tokens")).cast("long")
    per = per.withColumn("pieces", n).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return per.withColumn("tokens", F.least("capacity_tokens", F.col("total") - F.col("piece") * F.col("capacity_tokens"))).drop("total")


def prompts(documents: DataFrame, context_budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """budget_name, doc_id, piece, pieces, tokens, prompt_id, prompt_tokens, prompt_fill.

    Texts without tokens (null, empty) take no room and do not come out. Budgets without a
    name or with a capacity below 1 are left out. No budget or document: an empty result.
    """
    small = [(r.budget_name, r.capacity_tokens) for r in context_budgets.select("budget_name", "capacity_tokens").distinct().collect() if r.budget_name is not None and (r.capacity_tokens or 0) > 0]
    sized = with_tokens(documents, tokenizer)
    if not small:
        small, sized = [("", 1)], sized.limit(0)
    sized = cut(sized)
    buckets = buckets_for(sized.count())
    items = pieces(sized, small)
    items = items.withColumn("h", F.xxhash64("doc_id", "piece")).withColumn("b", hash_bucket(F.col("h"), buckets)).withColumn("one", F.lit(1))
    ranked = running_sum(items, ["budget_name", "tokens"], "b", ["h", "doc_id", "piece"], "one", "rank", before=True)
    histogram = items.groupBy("budget_name", "capacity_tokens", "tokens").agg(F.count("*").alias("items"))
    slots = histogram.groupBy("budget_name").applyInPandas(_slots, "tokens long, rank_from long, rank_to long, per_bin long, first_bin long, prompt_tokens long, budget_name string")
    slots = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("rank_from") / BLOCK), F.floor((F.col("rank_to") - 1) / BLOCK))))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = ranked.join(slots, ["budget_name", "tokens", "block"]).filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        "budget_name",
        "doc_id",
        F.col("piece").cast("long").alias("piece"),
        "pieces",
        "tokens",
        (F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_bin"))).alias("prompt_id"),
        "prompt_tokens",
        (F.col("prompt_tokens") / F.col("capacity_tokens")).alias("prompt_fill"),
    )


def fills(documents: DataFrame, context_budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each prompt with its number of items and its fill."""
    return prompts(documents, context_budgets, tokenizer).groupBy("budget_name", "prompt_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("prompt_tokens"), F.max("prompt_fill").alias("prompt_fill"))
