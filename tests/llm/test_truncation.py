import random

from tidewatch.llm import truncation as t

V = "validation_id long, finding_id long, model string, explanation string, suggested_fix string, value string, chars string"
D = "discovery_id long, model string, description string, value string"
SENTENCES = [
    "The value {w} reaches the query without any check.", "A filter exists in {i}, but it only removes blanks.", "Bind {w} as a parameter of the statement.", "The constant on line {n} is compared with the token sent by the client.",
    "Tests under the {w} folder call the same function with fixed text.", "An anonymous caller can reach this route before the login check.", "Limit {w} to digits and reject everything else with an error.",
]
WORDS = "order basket member ticket upload report sensor schedule".split()


def text(r, n):
    return " ".join(r.choice(SENTENCES).format(w=r.choice(WORDS), i=f"{r.choice(WORDS)}_{r.choice(WORDS)}", n=r.randrange(900)) for _ in range(n))


def made(seed, limit=180):
    """(rows, cut ids): model a has a field limit, model b is cut at random places, model c drops final stops."""
    r = random.Random(seed)
    rows, cut_ids = [], set()
    for i in range(900):
        model = "abc"[i % 3]
        s = text(r, r.randint(1, 5))
        if model == "a" and len(s) > limit:
            whole = s[:limit].rstrip()
            if not whole.endswith((".", "blanks", "check", "statement", "client", "text", "error")):
                cut_ids.add(i)
            s = s[:limit]
        elif model == "b" and i % 15 == 1:
            s = s[: r.randint(20, len(s) - 3)].rstrip()
            if s.endswith(".") or s.split()[-1] in ("blanks", "check", "statement", "client", "text", "error"):
                s = s.rsplit(" ", 1)[0] + " th"
            cut_ids.add(i)
        elif model == "c":
            s = s[:-1]
        rows.append((i, i, model, s, "N/A" if i % 2 else None, "clash", "clash"))
    return rows, cut_ids


def test_cut_values_are_found(spark):
    rows, want = made(5)
    v = spark.createDataFrame(rows + rows[:50], V)
    d = spark.createDataFrame([], D)
    got = {r.record_id for r in t.found(v, d).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * len(want)
    limits = {(r.model, r.length) for r in t.limit_lengths(v, d).collect() if r.unit == "chars"}
    assert ("a", 180) in limits
    share = {(r.model): r.truncated_share for r in t.rates(v, d).collect() if r.field_name == "explanation"}
    assert share["a"] > share["b"] > share.get("c", 0)


def test_marks_of_a_cut(spark):
    whole = "The value order reaches the query without any check."
    rows = [(i, i, "m", whole, None, "", "") for i in range(40)]
    ends = ["The value order reaches the qu [truncated]", "The value order reaches the query without a�", "The value order reaches the &quo", "```\nf(x)\nreturn", "call(order, [1, 2", "The value order reaches the que…", 'note = "open']
    rows += [(100 + i, i, "m", e, None, "", "") for i, e in enumerate(ends)]
    fine = ["Patch it", "N/A", "", " ", "```\nf(x)\n```", whole, None]
    rows += [(200 + i, i, "m", e, None, "", "") for i, e in enumerate(fine)]
    got = {r.record_id for r in t.found(spark.createDataFrame(rows, V), spark.createDataFrame([], D)).collect()}
    assert got == {100 + i for i in range(len(ends))}


def test_empty_null_and_long(spark):
    v, d = spark.createDataFrame([], V), spark.createDataFrame([], D)
    assert t.found(v, d).count() == 0 and t.rates(v, d).count() == 0
    d = spark.createDataFrame([(1, None, "word " * 50_000 + "end.", ""), (None, "m", "x", ""), (2, "m", None, "")], D)
    assert t.found(v, d).count() == 0
    assert [r.model for r in t.rates(v, d).collect()] == ["unknown"]


def test_hazards_use_the_risk_set(spark):
    """A spike of 300 at 338 leaves 13 at risk, and all 13 end at 341: few against the raw counts around, many against the hazards."""
    n = {length: 6 for length in range(300, 338)} | {3: 2, 338: 300, 341: 13}
    rows = [("m", "f", length, 10) for length, k in n.items() for _ in range(k)]
    h = {(r.unit, r.length): r for r in t.hazards(spark.createDataFrame(rows, "model string, field_name string, chars int, bytes int")).collect()}
    at_risk = lambda x: sum(k for length, k in n.items() if length >= x)
    for length, k in n.items():
        near = [x for x in range(max(length - t.NEIGHBOURS, 1), length + t.NEIGHBOURS + 1) if x != length]
        want = max(at_risk(length) * (sum(n.get(x, 0) for x in near) + 0.5) / sum(map(at_risk, near)), 0.02)
        r = h["chars", length]
        assert (r.n, r.at_risk) == (k, at_risk(length)) and abs(r.expected - want) < 1e-9
    assert {x for (unit, x), r in h.items() if unit == "chars" and r.significant} == {338, 341}


def test_last_tokens_are_those_of_the_whole_text():
    r = random.Random(3)
    for n in (0, 1, 5, 60, 400):
        s = " ".join(r.choice(["alpha", "b_c", "12", "(x)", "....", "`````", "ß", "z" * 300, "\n"]) for _ in range(n)).strip()
        whole, _ = t._tokens(s)
        assert t._last_tokens(s)[-4:] == whole[-4:]


def test_hot_ending_and_long_words(spark):
    """A third of all values share an ending; a cut word is found where the whole one has any length."""
    end = "The value reaches the query without any check."
    rows = [(i, i, "m", end, None, "", "") for i in range(300)] + [(1000 + i, i, "m", f"Limit order {i} to the {'verification' + 'n' * 500} step.", None, "", "") for i in range(20)]
    rows += [(2000, 1, "m", "Limit order 5 to the verif", None, "", "")]
    got = {r.record_id for r in t.found(spark.createDataFrame(rows, V), spark.createDataFrame([], D)).collect()}
    assert got == {2000}
