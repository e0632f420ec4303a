"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm import credentials, lookalikes, matching, mixing, packing, survivors, truncation
from tidewatch.session import table


def p3_found(spark, sf):
    return credentials.spans(table(spark, sf, "findings"))


def p3_redacted(spark, sf):
    return credentials.redacted(table(spark, sf, "findings"))


def p4_found(spark, sf):
    return matching.found(table(spark, sf, "engine_findings"))


def p4_matches(spark, sf):
    return matching.matches(table(spark, sf, "engine_findings"))


def p5_found(spark, sf):
    return truncation.found(table(spark, sf, "validations"), table(spark, sf, "discoveries"))


def p5_rates(spark, sf):
    return truncation.rates(table(spark, sf, "validations"), table(spark, sf, "discoveries"))


def p5_limit_lengths(spark, sf):
    x = truncation.limit_lengths(table(spark, sf, "validations"), table(spark, sf, "discoveries"))
    return x.select("model", "field_name", "unit", "length", "n", "at_risk", *[F.round(c, 6).alias(c) for c in ("hazard", "expected", "log_p")])


def p6_found(spark, sf):
    return survivors.found(table(spark, sf, "finding_reports"), table(spark, sf, "source_trust"))


def p6_survivors(spark, sf):
    return survivors.survivors(table(spark, sf, "finding_reports"), table(spark, sf, "source_trust"))


def p7_prompts(spark, sf):
    return packing.prompts(table(spark, sf, "documents"), table(spark, sf, "context_budgets"))


def p7_fills(spark, sf):
    return packing.fills(table(spark, sf, "documents"), table(spark, sf, "context_budgets"))


def p8_mixture(spark, sf):
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark, sf):
    return mixing.shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark, sf):
    return lookalikes.found(table(spark, sf, "documents"))


def p9_normalized(spark, sf):
    return lookalikes.normalized(table(spark, sf, "documents"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160)"


def _folded(c: str) -> str:
    return f"coalesce(lower(trim({c}, {_BLANKS})), '')"


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_P6 = f"""
WITH t AS (SELECT {_folded("source")} AS engine, trust_rank FROM source_trust),
r0 AS (SELECT DISTINCT report_id, fingerprint, source, severity, confidence, ai_validated, remediation, reported_at
       FROM finding_reports WHERE fingerprint IS NOT NULL AND report_id IS NOT NULL),
engines AS (SELECT DISTINCT source, {_folded("p")} AS engine FROM (SELECT source, unnest(string_split_regex(source, '[,;|+&/]')) AS p FROM r0)),
ranks AS (SELECT source, max(trust_rank) AS rank FROM engines JOIN t USING (engine) GROUP BY source),
r AS (SELECT r0.*, coalesce(rank, -1) AS rank FROM r0 LEFT JOIN ranks USING (source)),
many AS (SELECT fingerprint FROM r GROUP BY 1 HAVING count(DISTINCT report_id) > 1),
u AS (
  SELECT fingerprint, report_id, reported_at, rank, 'severity' AS field_name FROM r
   WHERE {_folded("severity")} IN ({", ".join(repr(s) for s in survivors.SEVERITIES)})
  UNION ALL SELECT fingerprint, report_id, reported_at, rank, 'confidence' FROM r WHERE confidence > 0 AND confidence <= 1
  UNION ALL SELECT fingerprint, report_id, reported_at, rank, 'ai_validated' FROM r
   WHERE NOT regexp_matches({_folded("ai_validated")}, {_rx(survivors.NO_VALUE)}) AND NOT regexp_matches({_folded("ai_validated")}, {_rx(survivors.NOT_CHECKED)})
  UNION ALL SELECT fingerprint, report_id, reported_at, rank, 'remediation' FROM r WHERE NOT regexp_matches({_folded("remediation")}, {_rx(survivors.NO_VALUE)}))
SELECT DISTINCT a.fingerprint, a.field_name, a.report_id FROM u a SEMI JOIN many USING (fingerprint)
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.fingerprint = a.fingerprint AND b.field_name = a.field_name
                  AND (b.reported_at > a.reported_at OR b.rank > a.rank))
"""

def _usable(f: str) -> str:
    v = _folded(f)
    if f == "severity":
        return f"{v} IN ({', '.join(repr(s) for s in survivors.SEVERITIES)})"
    if f == "confidence":
        return "coalesce(NOT isnan(confidence) AND confidence > 0 AND confidence <= 1, false)"
    return f"NOT regexp_matches({v}, {_rx(survivors.NO_VALUE)})" + (f" AND NOT regexp_matches({v}, {_rx(survivors.NOT_CHECKED)})" if f == "ai_validated" else "")


# Layers by a recursion over the cells: a cell is one deeper than the deepest that dominates it.
_P6_SURVIVORS = f"""
WITH RECURSIVE t AS (SELECT {_folded("source")} AS engine, trust_rank FROM source_trust),
r0 AS (SELECT DISTINCT report_id, fingerprint, source, severity, confidence, ai_validated, remediation, coalesce(reported_at, TIMESTAMP '0001-01-01') AS ts
       FROM finding_reports WHERE fingerprint IS NOT NULL AND report_id IS NOT NULL),
engines AS (SELECT DISTINCT source, {_folded("p")} AS engine FROM (SELECT source, unnest(string_split_regex(source, '[,;|+&/]')) AS p FROM r0)),
ranks AS (SELECT source, max(trust_rank) AS rank FROM engines JOIN t USING (engine) GROUP BY source),
r AS (SELECT r0.*, coalesce(rank, -1) AS rank, {", ".join(f"{_usable(f)} AS u{i}" for i, f in enumerate(survivors.FIELDS))} FROM r0 LEFT JOIN ranks USING (source)),
c AS (SELECT *, u0::INT + u1::INT + u2::INT + u3::INT AS complete FROM r QUALIFY row_number() OVER (PARTITION BY fingerprint, u0, u1, u2, u3, rank ORDER BY ts DESC, report_id) = 1),
dom AS (SELECT a.report_id AS a, b.report_id AS b FROM c a JOIN c b USING (fingerprint) WHERE a.complete >= b.complete AND a.ts >= b.ts AND a.rank >= b.rank AND (a.complete > b.complete OR a.ts > b.ts OR a.rank > b.rank)),
l AS (SELECT report_id, 1 AS n FROM c UNION SELECT dom.b, l.n + 1 FROM l JOIN dom ON dom.a = l.report_id),
d AS (SELECT report_id, max(n) AS layer FROM l GROUP BY 1), x AS (SELECT c.*, layer FROM c JOIN d USING (report_id)),
{", ".join(f"b{i} AS (SELECT fingerprint, {f} AS v, report_id AS i, layer AS l FROM x WHERE u{i} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY layer, rank DESC, ts DESC, complete DESC, report_id) = 1)" for i, f in enumerate(survivors.FIELDS))}
SELECT fingerprint, {", ".join(f"b{i}.v AS {f}, b{i}.i AS {f}_report_id, b{i}.l AS {f}_layer" for i, f in enumerate(survivors.FIELDS))}
FROM (SELECT DISTINCT fingerprint FROM r) g {" ".join(f"LEFT JOIN b{i} USING (fingerprint)" for i in range(len(survivors.FIELDS)))}
"""

_N = truncation.NEIGHBOURS
_P5_LENGTHS = f"""
WITH v AS (SELECT DISTINCT ON (validation_id) validation_id, model, explanation, suggested_fix FROM validations WHERE validation_id IS NOT NULL), d AS (SELECT DISTINCT ON (discovery_id) discovery_id, model, description FROM discoveries WHERE discovery_id IS NOT NULL),
u AS (SELECT model, 'explanation' AS field_name, explanation AS value FROM v UNION ALL SELECT model, 'suggested_fix', suggested_fix FROM v UNION ALL SELECT model, 'description', description FROM d),
w AS (SELECT CASE WHEN {_folded("model")} = '' THEN 'unknown' ELSE {_folded("model")} END AS model, field_name, value FROM u WHERE value IS NOT NULL AND NOT regexp_matches({_folded("value")}, {_rx(survivors.NO_VALUE)})),
h0 AS (SELECT model, field_name, 'chars' AS unit, length(value) AS length FROM w UNION ALL SELECT model, field_name, 'bytes', octet_length(encode(value)) FROM w),
h AS (SELECT model, field_name, unit, length, count(*) AS n FROM h0 GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (g RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk, sum(n) OVER (g RANGE BETWEEN {_N} PRECEDING AND {_N} FOLLOWING) AS near, sum(n * length) OVER (g RANGE BETWEEN {_N} PRECEDING AND {_N} FOLLOWING) AS reach,
  coalesce(sum(n) OVER (g RANGE BETWEEN {_N + 1} FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond, greatest(length - {_N}, 1) AS low FROM h WINDOW g AS (PARTITION BY model, field_name, unit ORDER BY length)),
e AS (SELECT *, n / at_risk AS hazard, greatest(at_risk * (near - n + 0.5) / greatest(reach - (low - 1) * near + beyond * (length + {_N} - low + 1) - at_risk, 1), 0.02)::DOUBLE AS expected FROM k),
p AS (SELECT *, CASE WHEN n > expected THEN -(n * ln(n / expected) - n + expected) ELSE 0 END AS log_p FROM e), s AS (SELECT count(*) AS tests FROM p),
q AS (SELECT *, row_number() OVER (ORDER BY log_p, model, field_name, unit, length) AS rank FROM p WHERE log_p <= ln({truncation.FALSE_DISCOVERY_RATE}) AND n >= {truncation.LEAST_DEATHS}),
z AS (SELECT max(log_p) AS cutoff FROM q, s WHERE log_p <= ln({truncation.FALSE_DISCOVERY_RATE} * rank / tests))
SELECT model, field_name, unit, length, n, at_risk, round(hazard, 6) AS hazard, round(expected, 6) AS expected, round(log_p, 6) AS log_p FROM p, z WHERE log_p <= cutoff AND n >= {truncation.LEAST_DEATHS}
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_limit_lengths": p5_limit_lengths,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_prompts": p7_prompts,
    "p7_fills": p7_fills,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_normalized": p9_normalized,
}
ORACLE = {"p5_limit_lengths": _P5_LENGTHS, "p6_found": _P6, "p6_survivors": _P6_SURVIVORS}
