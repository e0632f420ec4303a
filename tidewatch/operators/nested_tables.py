"""Deeply nested semi-structured records into related flat tables.

Method: Dewey labelling. Each object that is an element of a known list gets an ordinal
path identifier (``results[0].packages[2]``); the parent's identifier is its own one cut by
the last step, and nodes are grouped by schema path (the identifier without ordinals) into
one table per kind. The only Python is the parser (``mapInPandas``, Arrow batches): payloads
carry log text, markers, string-encoded documents and damage that no JSON expression of
Spark accepts. Everything after it is column expressions on the node relation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import cut

#: kind of the element, by name of its list and kind of the object that holds the list ("" = the document).
SHAPE = {
    "": {"results": "item", "vulns": "vulnerability"},
    "item": {"packages": "package"},
    "package": {"vulnerabilities": "vulnerability"},
    "vulnerability": {"severity": "severity", "affected": "affected"},
    "affected": {"ranges": "range"},
    "range": {"events": "event"},
}
KINDS = ("item", "package", "vulnerability", "severity", "affected", "range", "event")
ROOT_LISTS = tuple(SHAPE[""])

NODES = T.StructType(
    [
        T.StructField("result_id", T.LongType()),
        T.StructField("node_kind", T.StringType()),
        T.StructField("node_path", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)

_DECODE = json.JSONDecoder()
_START = re.compile(r'[{"]')
_OBJECT_HEAD = re.compile(r'\{\s*(?:"|\})')
_STRING_HEAD = re.compile(r'"(?:\\[nrt]|\s)*\{')


def _document(value: object) -> dict | None:
    """The object that has one of the root lists: the value itself, or inside lists, objects or encoded text, however deep."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if "{" in v and (d := find_document(v)) is not None:
                return d
        elif isinstance(v, dict):
            if any(k in v for k in ROOT_LISTS):
                return v
            stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return None


def find_document(text: str) -> dict | None:
    """The one advisory document in a payload, else None.

    Tried in turn: the whole text, then each place where an object or an encoded object
    may start. Where a place looks like an object but does not parse, the document is
    damaged there and the payload has none: fragments inside are never taken for it. Text
    encoded in text is read again (each level doubles its escapes, so the levels are few).
    Nesting that the JSON parser itself does not take (thousands of levels) counts as damage.
    """
    text = text.strip().lstrip("\ufeff").strip()
    try:
        return _document(json.loads(text))
    except (ValueError, RecursionError):
        pass
    at = 0
    while m := _START.search(text, at):
        at = m.start()
        head = _OBJECT_HEAD.match(text, at) or _STRING_HEAD.match(text, at)
        if not head:
            at += 1
            continue
        try:
            value, end = _DECODE.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None
        if (d := _document(value)) is not None:
            return d
        at = end
    return None


def label(document: dict) -> Iterator[tuple[str, str, dict]]:
    """(kind, Dewey path, object) of every node, parents before children. Iterative: depth is bounded by SHAPE."""
    stack = [("", "", document)]
    while stack:
        kind, path, obj = stack.pop()
        if path:
            yield kind, path, obj
        for name, child in SHAPE.get(kind, {}).items():
            held = obj.get(name)
            elements = held if isinstance(held, list) else [held] if isinstance(held, dict) else []
            for i, x in enumerate(elements):
                if isinstance(x, dict):
                    stack.append((child, f"{path}.{name}[{i}]" if path else f"{name}[{i}]", x))


def _own(kind: str, obj: dict) -> str:
    """The node's attributes without the lists that become child nodes."""
    return json.dumps({k: v for k, v in obj.items() if k not in SHAPE.get(kind, {})}, ensure_ascii=False)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (None if pd.isna(i) else int(i), kind, path, _own(kind, obj))
            for i, p in zip(b["result_id"], b["payload"])
            if isinstance(p, str) and (d := find_document(p)) is not None
            for kind, path, obj in label(d)
        ]
        out = pd.DataFrame(rows, columns=NODES.names)
        yield out.assign(result_id=out["result_id"].astype("Int64"))


def parent_path(path: Column) -> Column:
    """A node's parent: its Dewey path cut by the last step; empty for nodes of the root lists."""
    return F.regexp_replace(path, r"\.?[a-z]+\[\d+\]$", "")


def schema_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[\d+\]", "")


def nodes(results: DataFrame) -> DataFrame:
    """The node relation: result_id, node_kind, node_path, parent_path, schema_path, ordinal, attributes (JSON).

    A row delivered twice (same result_id and payload) counts once. Null, empty, damaged
    payloads and payloads without a document give no nodes. Null elements and elements that
    are no objects take their position but are no nodes; an object where a list is due is
    element 0. Very long payloads are parsed whole. Other columns are ignored.
    """
    once = results.select("result_id", "payload").filter(F.col("payload").isNotNull()).dropDuplicates(["result_id", "payload"])
    n = once.mapInPandas(_parse, NODES)
    return n.select(
        "result_id",
        "node_kind",
        "node_path",
        parent_path(F.col("node_path")).alias("parent_path"),
        schema_path(F.col("node_path")).alias("schema_path"),
        F.regexp_extract("node_path", r"\[(\d+)\]$", 1).cast("int").alias("ordinal"),
        "attributes",
    )


#: columns of each flat table: name -> JSON path in the node's attributes.
COLUMNS = {
    "item": {"source_path": "$.source.path", "source_type": "$.source.type"},
    "package": {"package_name": "$.package.name", "ecosystem": "$.package.ecosystem", "version": "$.package.version"},
    "vulnerability": {"advisory_id": "$.id", "summary": "$.summary", "details": "$.details", "aliases": "$.aliases", "published": "$.published", "modified": "$.modified"},
    "severity": {"severity_type": "$.type", "score": "$.score"},
    "affected": {"package_name": "$.package.name", "ecosystem": "$.package.ecosystem", "versions": "$.versions"},
    "range": {"range_type": "$.type", "repo": "$.repo"},
    "event": {"introduced": "$.introduced", "fixed": "$.fixed", "last_affected": "$.last_affected", "limit": "$.limit"},
}


def flat_table(node_rows: DataFrame, kind: str) -> DataFrame:
    """The table of one kind; (result_id, node_path) is its key, (result_id, parent_path) the link to the parent's table.

    Scalars come as text, lists and objects as JSON text, absent fields as null.
    """
    return node_rows.filter(F.col("node_kind") == kind).select(
        "result_id", "node_path", "parent_path", "ordinal", *[F.get_json_object("attributes", p).alias(c) for c, p in COLUMNS[kind].items()]
    )


def flat_tables(results: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per kind over one node relation (persist or write ``nodes`` first where all are read)."""
    n = nodes(results)
    return {k: flat_table(n, k) for k in KINDS}


def found(results: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p2_found."""
    return nodes(results).select("result_id", "node_kind", "node_path")


def affected_events(results: DataFrame) -> DataFrame:
    """Version events of each advisory with the affected package, joined back along the parent links."""
    n = cut(nodes(results))  # parsed once
    event = flat_table(n, "event").withColumn("affected_path", parent_path(F.col("parent_path")))
    affected = flat_table(n, "affected").select("result_id", F.col("node_path").alias("affected_path"), "package_name", "ecosystem")
    return event.join(affected, ["result_id", "affected_path"]).select("result_id", "node_path", "package_name", "ecosystem", "introduced", "fixed", "last_affected")
