"""Operator 8, secret scans with corpus-wide ownership.

One Arrow pass finds the base spans of each text and further candidates (long mixed tokens that no keyword
announces). Hashes of all candidate values are then aggregated over the corpus: in how many documents
(repositories) and under how many sources (owners) a value occurs. A value that more than ``max_owners``
sources share is a widely copied example; one that stays with its owners looks live. Candidates without a
keyword become spans of kind ``key`` only if they look live; base spans always stay, with their standing.

The aggregation counts (value, owner) first and owners after that, so an example found in a third of all
documents is a few partial rows per task. Values travel as SHA-256, never in clear.

Defined cases: null text has no spans; a null source is one owner; equal texts get equal spans; repeated
rows count as repositories of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import map_rows, saved

#: Patterns of the base kinds and the least length of what must be long (fixed values of the contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "key")
#: The method's own candidates: runs of key letters of this length.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Cheap forms that find where a base match can be; HEX of 24 or more is the same as HEX with a length test.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the base matches, by start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                out.append((m.start(), m.end(), "access", m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        out.append((m.start(), m.end(), "hex", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def key_spans(text: str, taken: list[tuple]) -> list[tuple[int, int, str, int, int]]:
    """Mixed-letter tokens of high entropy that meet no base span."""
    out = []
    for m in TOKEN.finditer(text):
        v = m.group()
        if not (re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v)) or _entropy(v) < 3.5:
            continue
        if not any(s < m.end() and m.start() < e for s, e, *_ in taken):
            out.append((m.start(), m.end(), "key", m.start(), m.end()))
    return out


FOUND = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("value_start", T.LongType()), T.StructField("value_end", T.LongType()), T.StructField("value", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("value", pa.string())]))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``found``: the base spans and the method's candidates of ``text``."""

    def run(b):
        out = []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            out.append([{"start": s, "end": e, "kind": k, "value_start": vs, "value_end": ve, "value": hashlib.sha256(text[vs:ve].encode()).hexdigest()}
                        for s, e, k, vs, ve in sorted(base + key_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2])))])
        return {"found": pa.array(out, _ARROW)}

    return map_rows(docs, run, T.StructType([T.StructField("found", FOUND)]), keep)


def ownership(found: DataFrame) -> DataFrame:
    """``value, repositories, owners`` of every candidate value of ``found(source, found)``."""
    values = found.select("source", F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value"))
    return (values.groupBy("value", "source").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners")))


def judge(rows: DataFrame, found: DataFrame, max_owners: int = 2) -> DataFrame:
    """``row, spans``: the spans of each of ``rows(row, found)`` that has any, with ``live``.

    Ownership comes from ``found(source, found)``; candidates of kind ``key`` that are not live are left out."""
    owners = ownership(found).select(F.col("value").alias("owned"), "repositories", "owners")
    each = rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
    each = each.join(owners, each["value"] == owners["owned"]).withColumn("live", F.col("owners") <= max_owners)
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind")).alias("order")
    kept = each.where(F.col("live") | (F.col("kind") != "key"))
    spans = F.array_sort(F.collect_list(F.struct("start", order, "end", "kind", "value_start", "value_end", "live", "owners", "repositories")))
    return kept.groupBy("row").agg(spans.alias("spans"))


def find_secrets(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind, value bounds, live, owners, repositories) for every row of
    ``docs(doc_id, source, text)``."""
    found = saved(scan(docs.select("doc_id", "source", "text"), ["doc_id", "source"]).withColumn("row", F.monotonically_increasing_id()), "secrets-found")
    some = judge(found.where(F.size("found") > 0), found, max_owners)
    return found.select("doc_id", "row").join(some, "row", "left").drop("row")


def redact(docs: DataFrame, max_owners: int = 2, mark: str = "[secret]") -> DataFrame:
    """Pipeline stage: live-looking values are replaced by ``mark``, and ``n_chars`` follows; all rows stay.

    Texts are told apart by digest, so nulls and repeated ids need no care and equal texts stay equal."""
    key, spans = "__secret_text", "__secret_spans"
    found = saved(scan(docs.select("source", "text").withColumn("row", F.md5("text")), ["row", "source"]).where(F.size("found") > 0), "secrets-found")
    live = judge(found.select("row", "found").dropDuplicates(["row"]), found, max_owners).select(F.col("row").alias(key), F.filter("spans", lambda x: x["live"]).alias(spans)).where(F.size(spans) > 0)
    d = docs.withColumn(key, F.md5("text")).join(live, key, "left")

    def run(b):
        out = []
        for text, found in zip(b.column("text").to_pylist(), b.column(spans).to_pylist()):
            if found:
                parts, at = [], 0
                for s, e in sorted((x["value_start"], x["value_end"]) for x in found):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return {"__secret_out": pa.array(out, pa.string())}

    d = map_rows(d, run, T.StructType([T.StructField("__secret_out", T.StringType())]))
    changed = F.col(spans).isNotNull()
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("__secret_out").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed & F.col(c).isNotNull(), F.char_length("__secret_out")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c))
    return d.select(*cols)


def _digest(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    d = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.coalesce("spans", F.array().cast(d.schema["spans"].dataType))
    base = F.filter(spans, lambda x: x["kind"] != "key")

    def count(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return d.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                    F.sha2(_digest(base), 256).alias("base_sha256"), _digest(spans).alias("spans"),
                    count("key").alias("n_key"), F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"))
