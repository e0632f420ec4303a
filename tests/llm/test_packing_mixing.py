import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import mixing, packing, tokens


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, tokens string, rank int")


def one_by_one(sizes, capacity):
    """Best-two-fit bin by bin, as the method says."""
    left = sorted(sizes)
    bins = []
    while left:
        used, gap = [], capacity
        while (fit := [x for x in left if x <= gap]) and gap:
            left.remove(fit[-1])
            used.append(fit[-1])
            gap -= fit[-1]
        if gap:
            small = min(used)
            room = gap + small
            best = max(((a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room), default=(0, 0))
            if best[0] > small:
                used.remove(small)
                left.append(small)
                for x in (best[1], best[0] - best[1]):
                    left.remove(x)
                    used.append(x)
                left.sort()
        bins.append(sorted(used))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(30, 50))
def test_histogram_packing_is_a_packing(sizes, capacity):
    s, n = np.unique(sizes, return_counts=True)
    out = packing.pack(s, n, capacity)
    placed = [x for bins, used in out for x, k in used.items() for _ in range(k * bins)]
    assert sorted(placed) == sorted(sizes)
    assert all(sum(x * k for x, k in used.items()) <= capacity for _, used in out)
    mine = sum(b for b, _ in out)
    assert mine <= len(one_by_one(sizes, capacity)) + 1
    assert mine >= -(-sum(sizes) // capacity)


def test_best_two_takes_the_tightest():
    s, n = np.array([2, 3, 5, 8]), np.array([1, 1, 2, 1])
    a, b = packing.best_two(s, n, 10)
    assert s[a] + s[b] == 10
    assert packing.best_two(np.array([4]), np.array([1]), 9) is None


def budgets(spark, *caps):
    return spark.createDataFrame([(f"b{c}", c) for c in caps], "budget_name string, capacity_tokens int")


def test_prompts_hold_each_text_once(spark):
    r = random.Random(1)
    rows = [("word " * r.choice((1, 3, 3, 3, 10, 25, 130)), "s") for _ in range(120)] + [(None, "s"), ("", "s")]
    d = docs(spark, rows)
    got = packing.prompts(d, budgets(spark, 40, 64)).toPandas()
    size = {i: len(tokens.encoding().encode_ordinary(t)) for i, (t, _) in enumerate(rows) if t}
    for cap in (40, 64):
        g = got[got.budget_name == f"b{cap}"]
        assert g.groupby("doc_id").tokens.sum().to_dict() == size
        assert (g.groupby("prompt_id").tokens.sum() == g.groupby("prompt_id").prompt_tokens.first()).all()
        assert g.groupby("prompt_id").tokens.sum().max() <= cap
        whole = g.groupby("doc_id").size()
        assert all(n == 1 for i, n in whole.items() if size[i] <= cap)
        assert sorted(g.prompt_id.unique()) == list(range(g.prompt_id.nunique()))


def test_prompts_of_nothing(spark):
    d = docs(spark, [("a b", "s")])
    assert packing.prompts(d.limit(0), budgets(spark, 10)).count() == 0
    assert packing.prompts(d, budgets(spark, 10).limit(0)).count() == 0


TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_shares_and_repeats(spark):
    r = random.Random(3)
    rows = [("tok " * r.randrange(1, 12), s) for s, n in (("a", 600), ("b", 200), ("c", 60)) for _ in range(n)] + [(None, "a"), ("x", None), ("y", "unwanted")]
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 4), ("m", "zero", 0.0, 1), ("n", "a", 0.5, None), ("n", "gone", 0.5, 1)], TARGETS)
    d = docs(spark, rows)
    got = mixing.mixture(d, t).toPandas()
    m = got[got.mix_name == "m"]
    share = m.groupby("source").tokens.sum() / m.tokens.sum()
    assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.3) < 0.03 and abs(share["c"] - 0.2) < 0.03
    assert (m.groupby(["source", "doc_id"]).size().groupby("source").max() <= {"a": 1, "b": 2, "c": 4}["c"]).all()
    assert m[m.source == "a"].repeat_no.max() == 1 and m[m.source == "b"].repeat_no.max() <= 2
    assert not m.duplicated(["source", "doc_id", "repeat_no"]).any()
    s = {(x.mix_name, x.source): x for x in mixing.shares(d, t).collect()}
    assert s["n", "gone"].actual_share == 0.0 and s["n", "a"].actual_share == 1.0 and ("m", "zero") not in s


def test_queue_is_fair_at_every_prefix(spark):
    rows = [("tok " * 4, s) for s in "ab" for _ in range(100)]
    t = spark.createDataFrame([("m", "a", 0.75, 1), ("m", "b", 0.25, 1)], TARGETS)
    m = mixing.mixture(docs(spark, rows), t).toPandas().sort_values("upto_tokens")
    run = (m.source == "a").cumsum() / range(1, len(m) + 1)
    assert abs(run.iloc[20:] - 0.75).max() < 0.1
    assert (m.upto_tokens.diff().dropna() == m.tokens.iloc[1:]).all()


def test_empty_mix(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    d = docs(spark, [("x", "a")])
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0
