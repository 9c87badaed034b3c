"""Operator 5, document fingerprints by one-permutation MinHash, in SQL functions only.

The word shingles of a text are hashed once. The high bits of a hash choose its bin, each bin keeps its
smallest hash, an empty bin takes over the value of the first filled bin on a fixed walk of its own over all
bins (optimal densification), and the low bits of the values, hashed once more with the bin's number, are packed into a hex string. Two
fingerprints agree in a bin by chance once in 2**BITS, each bin on its own even where one value fills many;
the likeness corrects for that.

The walk of bin i starts at a place and takes an odd stride that both come from a hash of i, so that it meets
every bin once and always ends.

Each document's neighbour, the next by id, comes from a window over groups of neighbouring ids; the last of a
group looks at the first of the next group, found among one row per group. So texts are shuffled once and no
window spans the table.

Defined cases: null text is empty; a text without words has the empty fingerprint, whose likeness to another
empty one is 1 and to any other 0; fewer than five words are one shingle; rows of one id follow each other by
text; rows without an id come first; a table of one row has itself as neighbour; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, saved

BINS, BITS, WORDS = 256, 4, 5
#: Rows of a group of neighbouring ids, on the average.
GROUP = 1024


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def signature(text: str) -> F.Column:
    """SQL: the low bits of the densified bins of column ``text``; no elements for a text without words."""
    shift = 64 - (BINS - 1).bit_length()
    probe = ", ".join(f"get(bins, (p + {a} * q) & {BINS - 1})" for a in range(BINS))
    walk = _let("xxhash64(i)", "h", _let(f"CAST(h & {BINS - 1} AS INT)", "p", _let("CAST((shiftright(h, 8) & 127) * 2 + 1 AS INT)", "q", f"coalesce({probe})")))
    filled = _let("map_from_arrays(transform(least, x -> CAST(shiftrightunsigned(x, {s}) AS INT)), least)".format(s=shift),
                  "m", f"transform(sequence(0, {BINS - 1}), b -> element_at(m, b))")
    dense = _let(filled, "bins", f"transform(bins, (v, i) -> CAST(xxhash64(coalesce(v, {walk}), i) & {2**BITS - 1} AS TINYINT))")
    least = f"filter(sorted, (x, i) -> i = 0 OR shiftrightunsigned(x, {shift}) <> shiftrightunsigned(get(sorted, i - 1), {shift}))"
    hashes = f"transform(sequence(1, greatest(size(w) - {WORDS - 1}, 1)), i -> xxhash64(slice(w, i, {WORDS})))"
    whole = _let(f"sort_array({hashes})", "sorted", _let(least, "least", dense))
    word = WORD.replace("\\", "\\\\")
    return F.expr(_let(f"regexp_extract_all(lower({text}), '{word}', 0)", "w", f"IF(size(w) > 0, {whole}, CAST(array() AS ARRAY<TINYINT>))"))


def packed(signature_column: str) -> F.Column:
    """Hex string of a signature, one digit per bin."""
    return F.expr(f"array_join(transform({signature_column}, x -> substr('0123456789abcdef', x + 1, 1)), '')")


def likeness(a: str, b: str) -> F.Column:
    """Estimated similarity of two signatures, freed of chance agreement, 0 to 1."""
    same = f"aggregate(sequence(0, {BINS - 1}), 0, (n, i) -> n + IF(get(s.a, i) = get(s.b, i), 1, 0))"
    chance = 1 / 2**BITS
    value = f"greatest(0D, ({same} / {BINS}D - {chance}D) / {1 - chance}D)"
    return F.expr(_let(f"named_struct('a', {a}, 'b', {b})", "s", f"IF(size(s.a) = 0 OR size(s.b) = 0, IF(size(s.a) = size(s.b), 1D, 0D), {value})"))


def successors(keys: DataFrame, group: int = GROUP) -> DataFrame:
    """``k, next_k`` for distinct keys ``k`` (long): the next larger one, null for the largest.

    Groups of neighbouring keys are walked side by side, their ends by the same method one level up."""
    n, lo, hi = keys.agg(F.count("k"), F.min("k"), F.max("k")).first()
    if n <= 8 * group:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("next_k"))
    width = max(2, (hi - lo) * group // n + 1)
    d = keys.select("k", F.expr(f"k div {width}").alias("g"))
    firsts = d.groupBy("g").agg(F.min("k").alias("first"))
    above = successors(firsts.select(F.col("g").alias("k")), group).select(F.col("k").alias("g"), F.col("next_k").alias("next_g"))
    ends = above.join(firsts.select(F.col("g").alias("next_g"), "first"), "next_g").select("g", "first")
    inner = d.select("k", "g", F.lead("k").over(Window.partitionBy("g").orderBy("k")).alias("next_k"))
    return inner.join(ends, "g", "left").select("k", F.coalesce("next_k", "first").alias("next_k"))


def with_next(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, text, sig, next_text, next_sig``: each row of ``docs(doc_id, text)`` and the next by id (after
    the last: the first), with their signatures.

    The first id of each group is written, one row for ``group`` documents, so that the planner knows its size
    and the texts of the firsts are fetched without another shuffle of all texts."""
    n, lo, hi = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) * group // max(1, n) + 1)
    d = docs.withColumn("g", F.expr(f"coalesce(doc_id div {width}, {(lo or 0) // width - 2}L)"))  # without an id: before all others
    ids = saved(d.groupBy("g").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    heads = d.join(ids.withColumnRenamed("g", "h"), (F.col("g") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("first")))
    heads = heads.groupBy("g").agg(F.min("text").alias("text")).select("g", F.struct("text", signature("text").alias("sig")).alias("head"))
    start = ids.agg(F.min("g")).first()[0]
    groups = successors(ids.select(F.col("g").alias("k")), group).select(F.col("k").alias("of"), F.coalesce("next_k", F.lit(start).cast("long")).alias("g"))
    behind = groups.join(heads, "g").select(F.col("of").alias("g"), "head")
    w = Window.partitionBy("g").orderBy("doc_id", "text")
    d = d.withColumn("sig", signature("text")).withColumn("nxt", F.lead(F.struct("text", "sig")).over(w))
    d = d.join(behind, "g", "left").withColumn("nxt", F.coalesce("nxt", "head"))
    return d.select("doc_id", "text", "sig", F.col("nxt.text").alias("next_text"), F.col("nxt.sig").alias("next_sig"))


def whole_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every row, null texts empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, sig`` for every row of ``docs(doc_id, text)``; ``packed('sig')`` is the stored form."""
    return whole_texts(docs).select("doc_id", signature("text").alias("sig"))


def query(spark, sf_dir: str) -> DataFrame:
    d = with_next(whole_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    half = "CAST(n_chars div 2 AS INT)"
    d = d.withColumn("edited", F.expr(f"concat(substring(text, 1, CAST(n_chars AS INT) - {half}), substring(next_text, 1, {half}))"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature("edited").alias("edited_sig"))
    return d.select("doc_id", "n_chars", "edited_sha256", packed("sig").alias("fingerprint"), packed("edited_sig").alias("edited_fingerprint"),
                    likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
