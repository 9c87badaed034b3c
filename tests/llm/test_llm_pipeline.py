"""The pipeline's stages against a plain Python version, and its entry."""

import random
from collections import Counter

import corpus_pipeline
from tallyspark.llm import mixing

from .test_llm_operators import DOCS, brute_components, docs, near_rows, written


def test_pipeline_stages_follow_one_another(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in near_rows(rng)] + [(900, "word " * 5 + "password: zk39qLm42x", "en", "s1"), (901, "12345 !!", "en", "s1")]
    d = docs(spark, rows)
    path = written(spark, d, tmp_path, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secrets", "mixing", "packing"]
    frames, now = [], spark.read.parquet(f"{path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, path).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == [x.split()[0] for x in DOCS.split(", ")]
        frames.append([tuple(r) for r in now.collect()])
    lang, unique, clean, mixed = frames
    assert {r[0] for r in lang} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    comp = brute_components([(r[0], r[1]) for r in lang])
    assert sorted(r[0] for r in unique) == sorted(i for i, (_, c) in comp.items() if i == c)
    assert [r[1] for r in clean if r[0] == 900] == ["word word word word word password: [secret]"] and len(clean) == len(unique)
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(clean, DOCS)).collect()}
    assert Counter(r[0] for r in mixed) == +Counter(copies)
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r[0] for r in mixed)


def test_entry_lists_the_queries():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x[:2] == "op" and x[2].isdigit()} and "pipeline" in names
    assert {"op6_exact_topk", "op11_ranked_search", "op13_phrase_mining"} <= set(__spark_entry__.oracle_sql())
