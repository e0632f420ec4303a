"""Texts cut off by field limits or mid-transfer, and how often each model's fields are.

Two kinds of evidence meet:

* Discrete length hazards. For each model and field, h(L) = values of length L / values at
  least that long, in code points and in bytes, by window functions over the length histogram.
  Each hazard is tested against that of its neighbouring lengths: the count against its risk
  set times their deaths over their exposure (upper tail of a Poisson count, Chernoff bound),
  with Benjamini-Hochberg control of the false-discovery rate.
* Endings. A value's last tokens are looked up in the corpus of all values: how often does a
  text go on after these tokens, how often does a sentence, code block or value end there.
  Open brackets, fences, quotes, broken characters and cut escapes settle it at once.

At a significant length an ending counts as incomplete on weaker evidence than elsewhere. The
named method flags at significant lengths only; values cut mid-transfer have no common length,
so incomplete endings elsewhere are flagged too, on stronger evidence.

Ending statistics cover all values and whole texts. Contexts of three tokens are counted in the
workers before the shuffle (one row a distinct context and batch of input); shorter contexts are
their sums. Values are looked up by their last context: distinct endings once, and rows of a
frequent ending in parts, so neither a hot model nor a hot ending forms a large group.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import folded
from tidewatch.llm.survivors import NO_VALUE
from tidewatch.operators.prefix import running_sum
from tidewatch.session import cut

#: A text goes on after this share of an ending's other occurrences, or it counts as complete.
END_SHARE_AT_LIMIT = 0.4
END_SHARE_ELSEWHERE = 0.25
NEIGHBOURS = 12
FALSE_DISCOVERY_RATE = 0.01
#: Fewer values of one length show no limit.
LEAST_DEATHS = 3

_TOKEN = re.compile(r"```|\n|[^\W\d]\w*|\d+|[^\w\s]")
_MARKS = frozenset(".!?。！？")
#: A sentence ends between a mark and a blank; no token spans that place.
_SENTENCE = re.compile(r"(?<=[.!?。！？])(?=\s)")
_CUT_NOTE = re.compile(r"(?i)\b(?:truncated|cut off|cut|snip(?:ped)?|output limit reached|max(?:imum)? (?:length|tokens) reached|abgeschnitten|gekürzt|tronqué)$")
_CUT_ESCAPE = re.compile(r"&(?:#?\w{0,7})$|\\(?:u[0-9a-fA-F]{0,3})?$")
_OPENING = re.compile(r'\\.|["()\[\]{}\n]', re.S)
_BROKEN = "�"
#: Longest cut note and longest cut escape with a character before it: nothing further back can matter.
_NOTE, _ESCAPE = 40, 10
#: Distinct contexts a worker holds before it hands them on.
_HELD = 200_000
#: Parts that the values of one ending are split into where they are joined.
SALTS = 8
#: Joins the tokens of a context; a control character is never part of a token.
SEP = "\x1f"


def values(validations: DataFrame, discoveries: DataFrame) -> DataFrame:
    """record_kind, record_id, model, field_name, value: non-blank values that are no stand-ins, each record once."""
    v = validations.select("validation_id", "model", "explanation", "suggested_fix").dropDuplicates(["validation_id"])
    fields = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("explanation", "suggested_fix")]))
    a = v.select(F.lit("validation").alias("record_kind"), F.col("validation_id").alias("record_id"), "model", fields)
    b = discoveries.dropDuplicates(["discovery_id"]).select(F.lit("discovery").alias("record_kind"), F.col("discovery_id").alias("record_id"), "model", F.lit("description").alias("field_name"), F.col("description").alias("value"))
    u = a.unionByName(b).filter(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    u = u.withColumn("model", F.coalesce(F.when(folded(F.col("model")) != "", folded(F.col("model"))), F.lit("unknown")))
    return u.filter(~folded(F.col("value")).rlike(NO_VALUE))


@lru_cache(maxsize=100_000)
def _token(t: str) -> str:
    return "<n>" if t.isdigit() else "<id>" if "_" in t[1:] and t[0] not in "`\n" else t


def _sentence(text: str) -> tuple[str, ...]:
    """Tokens with names and numbers made alike."""
    return tuple(map(_token, _TOKEN.findall(text)))


_kept_sentence = lru_cache(maxsize=50_000)(_sentence)


def _tokens(text: str) -> tuple[list[str], set[int]]:
    """All tokens, and the positions after which a sentence, block or the text may end: at a sentence's mark, before it, and before a fence."""
    toks: list[str] = []
    ends: set[int] = set()
    for part in _SENTENCE.split(text):
        toks += _kept_sentence(part) if len(part) < 1000 else _sentence(part)
        k = len(toks) - 1
        if k >= 0 and toks[k] in _MARKS:
            ends.add(k)
            if k > 0 and toks[k - 1] not in _MARKS:
                ends.add(k - 1)
    if "```" in text:
        for i, t in enumerate(toks):
            if t == "```" and i > 0:
                ends.add(i - 1)
                if toks[i - 1] == "\n" and i > 1:
                    ends.add(i - 2)
    if toks:
        ends.add(len(toks) - 1)
    return toks, ends


#: Stands before the first token of a text.
_START = "^"


def _context(toks: list[str], i: int) -> tuple[str, ...]:
    """The three tokens up to position i, or all of them after the start."""
    return tuple(toks[i - 2 : i + 1]) if i >= 2 else (_START, *toks[: i + 1])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of contexts of three tokens: how often seen, how often at an end."""

    def flush(seen: Counter, ended: Counter) -> pd.DataFrame:
        return pd.DataFrame([(SEP.join(c), n, ended.get(c, 0)) for c, n in seen.items()], columns=["context", "seen", "ended"])

    seen: Counter = Counter()
    ended: Counter = Counter()
    for b in batches:
        for text, at_limit in zip(b["value"], b["at_limit"]):
            t, dots = _bare(text)
            toks, ends = _tokens(t)
            if not toks:
                continue
            if (dots or at_limit) and toks[-1] not in _MARKS:
                ends.discard(len(toks) - 1)  # the value's own end may be a cut
            seen.update(_context(toks, i) for i in range(min(2, len(toks))))
            seen.update(zip(toks, toks[1:], toks[2:]))
            ended.update(_context(toks, i) for i in ends)
            if len(seen) > _HELD:
                yield flush(seen, ended)
                seen, ended = Counter(), Counter()
    yield flush(seen, ended)


def _bare(text: str) -> tuple[str, bool]:
    """The text without outer blanks and without a closing ellipsis; whether one stood there."""
    t = text.strip()
    bare = t[:-1].rstrip() if t.endswith("…") else t.rstrip(".").rstrip() if t.endswith("...") else ""
    return (bare, True) if bare else (t, False)


def _open(text: str) -> bool:
    """Whether a bracket, fence or quoted piece is still open at the end."""
    if text.count("```") % 2:
        return True
    depth: list[str] = []
    quoted = False
    for m in _OPENING.finditer(text):
        ch = m[0]
        if len(ch) > 1:  # an escaped character
            continue
        if quoted:
            quoted = ch not in '"\n'
        elif ch == '"':
            quoted = True
        elif ch in "([{":
            depth.append(ch)
        elif ch != "\n" and depth and depth[-1] == {")": "(", "]": "[", "}": "{"}[ch]:
            depth.pop()
    return quoted or bool(depth)


def _noted(t: str) -> bool:
    """Whether a bracketed note at the end says that the text was cut."""
    return t[-1:] in tuple("])>}") and _CUT_NOTE.search(t[:-1].rstrip()[-_NOTE:]) is not None


def _last_tokens(t: str) -> list[str]:
    """The last tokens, four at least if the text has so many. Read from a blank on: no token spans one."""
    size = 48
    while size < len(t):
        at = len(t) - size
        while at > 0 and not t[at].isspace():
            at -= 1
        if at and len(toks := list(map(_token, _TOKEN.findall(t, at)))) > 3:
            return toks
        size *= 4
    return list(map(_token, _TOKEN.findall(t)))


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a value's ending shows by itself, and its last context."""
    for b in batches:
        rows = []
        for text in b["value"]:
            t, dots = _bare(text)
            toks = _last_tokens(t)
            if not toks:
                rows.append((False, dots, False, False, ""))
                continue
            sure = t.endswith(_BROKEN) or _noted(t) or _CUT_ESCAPE.search(t[-_ESCAPE:]) is not None or _open(t)
            rows.append((sure, dots, not sure and t.endswith("```"), toks[-1] in _MARKS, SEP.join(_context(toks, len(toks) - 1))))
        out = pd.DataFrame(rows, columns=["sure", "dots", "closed", "on_mark", "c3"])
        keys = b[["record_kind", "record_id", "model", "field_name", "chars", "bytes", "at_limit"]].reset_index(drop=True)
        yield pd.concat([keys, out], axis=1)


LOOKED = (
    "record_kind string, record_id long, model string, field_name string, chars int, bytes int, at_limit boolean, "
    "sure boolean, dots boolean, closed boolean, on_mark boolean, c3 string"
)


def hazards(sized: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """model, field_name, unit, length, n, at_risk, hazard, expected, log_p, significant.

    ``sized`` has model, field_name, chars, bytes. The histogram is pre-aggregated; windows run
    over it inside (model, field, unit).
    """
    units = F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    h = sized.select("model", "field_name", units).groupBy("model", "field_name", "unit", "length").agg(F.count("*").alias("n"))
    g = W.partitionBy("model", "field_name", "unit")
    by_length = g.orderBy("length")
    h = h.withColumn("at_risk", F.sum("n").over(by_length.rangeBetween(W.currentRow, W.unboundedFollowing)))
    near = by_length.rangeBetween(-neighbours, neighbours)
    # Deaths and exposure over the neighbouring lengths from 1 on. Exposure is the sum of their risk sets, also at lengths without
    # a row: a value in reach is at risk at each of them up to its own length, a longer one at all of them.
    others = F.sum("n").over(near) - F.col("n")
    low = F.greatest(F.col("length").cast("long") - neighbours, F.lit(1))
    beyond = F.coalesce(F.sum("n").over(by_length.rangeBetween(neighbours + 1, W.unboundedFollowing)), F.lit(0))
    reach = F.sum(F.col("length").cast("long") * F.col("n")).over(near) - (low - 1) * F.sum("n").over(near)
    exposure = reach + beyond * (F.col("length") + neighbours - low + 1) - F.col("at_risk")
    expected = F.greatest(F.col("at_risk") * (others + 0.5) / F.greatest(exposure, F.lit(1)), F.lit(0.02))
    h = h.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("expected", expected)
    n, mu = F.col("n").cast("double"), F.col("expected")
    h = h.withColumn("log_p", F.when(n > mu, -(n * F.ln(n / mu) - n + mu)).otherwise(0.0))
    # One false-discovery control over all tests. Only p-values up to the rate itself can pass, so only those are ranked.
    h = h.withColumn("all", F.lit(0))
    tests = h.groupBy("all").agg(F.count("*").alias("tests"))
    low = h.filter((F.col("log_p") <= math.log(FALSE_DISCOVERY_RATE)) & (F.col("n") >= LEAST_DEATHS)).withColumn("b", F.greatest(F.floor("log_p"), F.lit(-4096)).cast("int")).withColumn("one", F.lit(1))
    ranked = running_sum(low, ["all"], "b", ["log_p", "model", "field_name", "unit", "length"], "one", "rank").join(tests, "all")
    cutoff = ranked.filter(F.col("log_p") <= F.ln(F.lit(FALSE_DISCOVERY_RATE) * F.col("rank") / F.col("tests"))).groupBy("all").agg(F.max("log_p").alias("cutoff"))
    h = h.join(cutoff, "all", "left").withColumn("significant", F.coalesce(F.col("log_p") <= F.col("cutoff"), F.lit(False)) & (F.col("n") >= LEAST_DEATHS))
    return h.drop("all", "cutoff")


def with_limits(v: DataFrame) -> DataFrame:
    """``values`` with at_limit: whether the length is significant for the model and field, in either unit."""
    v = v.withColumn("chars", F.length("value")).withColumn("bytes", F.octet_length("value").cast("int"))
    hz = hazards(v).filter("significant")
    for u in ("chars", "bytes"):
        limit = hz.filter(F.col("unit") == u).select("model", "field_name", F.col("length").alias(u), F.lit(True).alias(f"{u}_limit"))
        v = v.join(limit, ["model", "field_name", u], "left")
    return v.withColumn("at_limit", F.coalesce("chars_limit", "bytes_limit", F.lit(False))).drop("chars_limit", "bytes_limit")


def judged(validations: DataFrame, discoveries: DataFrame) -> DataFrame:
    """record_kind, record_id, model, field_name, chars, bytes, at_limit, end_share, incomplete for every value.

    Null and blank values and stand-ins are no values. Records delivered twice count once.
    ``end_share`` is the share of the ending's other occurrences at which a text ends (null if
    there is none); contexts of three tokens are tried first, then two, then one. A last word
    that other values go on to spell (after the same two tokens) is cut inside.
    """
    v = cut(with_limits(values(validations, discoveries)))
    looked = cut(v.mapInPandas(_look, LOOKED))
    x = _salted(looked, "record_id", "c3", _endings(v, looked))

    share = F.lit(None).cast("double")
    for c in ("c1", "c2", "c3"):
        others = F.col(f"{c}_seen") - 1
        own = F.when(F.col("at_limit") | F.col("dots"), F.col("on_mark").cast("int")).otherwise(1)
        share = F.when(others > 0, (F.col(f"{c}_ended") - own) / others).otherwise(share)
    x = x.withColumn("end_share", share)
    inside = F.coalesce(F.col("longer_seen") >= F.col("c3_seen"), F.lit(False))
    # A last word no other value has, after words that others have: cut inside the word.
    unseen = (F.col("last_word") != "") & (F.col("c1_seen") <= 1) & (F.coalesce("before_seen", F.lit(0)) > 1)
    least = F.when(F.col("at_limit") | F.col("dots"), END_SHARE_AT_LIMIT).otherwise(END_SHARE_ELSEWHERE)
    weak = inside | F.coalesce(F.col("end_share") < least, unseen)
    return x.select("record_kind", "record_id", "model", "field_name", "chars", "bytes", "at_limit", "end_share", (F.col("sure") | (weak & ~F.col("closed"))).alias("incomplete"))  # a closed fence is an end


def _last_word(c3: Column) -> Column:
    w = F.substring_index(c3, SEP, -1)
    return F.when(w.rlike(r"^\p{L}"), w).otherwise("")


def _before(c3: Column) -> Column:
    """The context without its last token; empty for a text of one token."""
    return F.when(F.size(F.split(c3, SEP)) == 3, F.substring_index(c3, SEP, 2)).otherwise("")


def _shorter(c3: Column, n: int) -> Column:
    """The context of n tokens within one of three (with the start where the text has no more)."""
    return F.substring_index(c3, SEP, -n)


def _salted(df: DataFrame, by: Column | str, key: str, right: DataFrame) -> DataFrame:
    """Left join on ``key``; rows of a frequent key are split by ``by``, the right side (unique in the key) stands in all parts."""
    left = df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "salt"], "left").drop("salt")


def _endings(v: DataFrame, looked: DataFrame) -> DataFrame:
    """For each distinct last context: how often it and its shorter forms are seen and end, and how often a longer word stands there."""
    three = cut(v.select("value", "at_limit").mapInPandas(_count, "context string, seen long, ended long").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended")))
    asked = looked.select("c3").filter("c3 <> ''").distinct()
    asked = asked.select("c3", _shorter(F.col("c3"), 2).alias("c2"), _shorter(F.col("c3"), 1).alias("c1"), _before(F.col("c3")).alias("before"), _last_word(F.col("c3")).alias("last_word"))

    def known(level: int, name: str) -> DataFrame:
        wanted = asked.select(F.col(name).alias(name)).distinct()
        counts = three.select((F.col("context") if level == 3 else _shorter(F.col("context"), level)).alias(name), "seen", "ended")
        return counts.groupBy(name).agg(F.sum("seen").alias(f"{name}_seen"), F.sum("ended").alias(f"{name}_ended")).join(wanted, name, "left_semi")

    x = asked.join(known(3, "c3"), "c3", "left")
    for level, name in ((2, "c2"), (1, "c1"), (2, "before")):
        x = _salted(x, "c3", name, known(level, name))

    # Longer words that follow the same two tokens elsewhere: each is cut to the lengths asked for there and met by equality.
    words = asked.filter("last_word <> ''").select("before", "last_word").distinct()
    lengths = words.groupBy("before").agg(F.collect_set(F.length("last_word")).alias("lengths"))
    after = three.filter(F.size(F.split("context", SEP)) == 3).select(F.substring_index("context", SEP, 2).alias("before"), F.substring_index("context", SEP, -1).alias("next"), "seen")
    after = after.join(lengths, "before").select("before", "next", "seen", F.explode(F.filter("lengths", lambda n: n < F.length("next"))).alias("n"))
    spelled = after.select("before", F.expr("substring(next, 1, n)").alias("last_word"), "seen").groupBy("before", "last_word").agg(F.sum("seen").alias("longer_seen"))
    return x.join(spelled, ["before", "last_word"], "left").drop("c2", "c1", "before", "before_ended")


def found(validations: DataFrame, discoveries: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p5_found."""
    return judged(validations, discoveries).filter("incomplete").select("record_kind", "record_id", "field_name")


def rates(validations: DataFrame, discoveries: DataFrame) -> DataFrame:
    """How often each model's fields are cut: values, truncated, at_limit and share."""
    j = judged(validations, discoveries)
    return j.groupBy("record_kind", "field_name", "model").agg(F.count("*").alias("n_values"), F.count_if("incomplete").alias("n_truncated"), F.count_if(F.col("incomplete") & F.col("at_limit")).alias("n_at_limit"), (F.count_if("incomplete") / F.count("*")).alias("truncated_share"))


def limit_lengths(validations: DataFrame, discoveries: DataFrame) -> DataFrame:
    """The significant lengths of each model and field."""
    sized = values(validations, discoveries).select("model", "field_name", F.length("value").alias("chars"), F.octet_length("value").alias("bytes"))
    return hazards(sized).filter("significant").select("model", "field_name", "unit", "length", "n", "at_risk", "hazard", "expected", "log_p")
