"""The pipeline's stages against plain Python, and over rows of every odd kind."""

import zlib

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F
from test_set_operators import brute_components
from test_text_operators import base_measures

import corpus_pipeline
from prefixery.llm import quality_rules, source_mixing
from prefixery.llm.chunk_encoder import default_vocabulary


def stage_outputs(spark, docs, sf_dir, tmp_path):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, sample_docs, sf_small, tmp_path):
    from tokenizers import Tokenizer
    outs = stage_outputs(spark, sample_docs, sf_small, tmp_path)
    ids = [{r["doc_id"] for r in o.select("doc_id").collect()} for o in outs]
    text = {r["doc_id"]: r["text"] for r in sample_docs.collect()}
    source = {r["doc_id"]: r["source"] for r in sample_docs.collect()}
    rated = {r["doc_id"]: r for r in quality_rules.rate(sample_docs).collect()}
    passed = {i for i in text if not base_measures(text[i])[-1]}
    assert ids[0] == {i for i in passed if rated[i]["lower"] <= rated[i]["perplexity"] <= rated[i]["upper"]}
    assert len(ids[0]) > 0.9 * len(passed) > 0 and len(passed) < len(text)
    assert ids[1] == set(brute_components([(i, text[i]) for i in ids[0]]).values()) < ids[0]
    items = [" ".join(words(r["text"], True)) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    windows = {x[k:k + 50] for x in items for k in range(len(x) - 49)}
    plain = {i: " ".join(words(text[i], True)) for i in ids[1]}
    exact = {i for i, t in plain.items() if any(t[k:k + 50] in windows for k in range(len(t) - 49))}
    assert exact and ids[2] <= ids[1] - exact and len(ids[1] - exact - ids[2]) <= 2
    assert ids[3] == ids[2] == ids[4]
    assert all(o.columns == sample_docs.columns for o in outs[:4])

    rows = outs[4].orderBy("start").collect()
    left = {}
    for i in sorted(ids[2]):
        left.setdefault(source[i], []).append(i)
    weights = source_mixing.tempered(outs[3])
    share = source_mixing.integer_weights(weights)
    plan = source_mixing.phases({s: len(x) for s, x in left.items()}, share, source_mixing.BLOCK)
    order = []
    for s, a, b, slot0, _, q, n, slots in plan:
        for k in range(a, b):
            slot = slot0 + (k - a) // n * q + slots[(k - a) % n]
            order.append((slot, left[s][k * source_mixing.BLOCK:(k + 1) * source_mixing.BLOCK]))
    assert [r["doc_id"] for r in rows] == [i for _, block in sorted(order) for i in block]
    t, start = Tokenizer.from_file(default_vocabulary()), 0
    for r in rows:
        own = t.encode(text[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_odd_rows_and_empty_tables(spark, edge_docs, sf_small, tmp_path):
    docs = edge_docs.drop("mix_slot")
    outs = stage_outputs(spark, docs, sf_small, tmp_path / "odd")
    assert all(o.columns == docs.columns for o in outs[:4])
    assert outs[4].count() == outs[3].count() == outs[2].count() > 0
    none = stage_outputs(spark, docs.where("1 = 0"), sf_small, tmp_path / "none")
    assert [o.count() for o in none] == [0] * 5


def test_run_is_the_chain_of_stages(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("copies", [480, 100])
def test_copies_do_not_set_the_band(spark, sample_docs, sf_small, copies):
    """One text at about 80% and 45% of a language: nearly all other documents are
    kept or rejected as without its copies."""
    docs = sample_docs.where("lang = 'en'").dropDuplicates(["text"]).select("doc_id", "text", "lang").cache()
    one = docs.where("length(text) > 1500").orderBy("doc_id").limit(1)
    noise = spark.createDataFrame([(-1, "zq xj kv wp " + " ".join(f"{k:x}q~{k * 7919 % 9973}" for k in range(400)), "en")], docs.schema)
    docs = docs.unionByName(noise)
    many = docs.unionByName(one.withColumn("doc_id", F.explode(F.sequence(F.lit(10 ** 6), F.lit(10 ** 6 + copies - 1)))))
    want = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, sf_small).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, many, sf_small).collect()}
    assert -1 not in want and -1 not in got and len(want) > 60
    assert len({i for i in got if i < 10 ** 6} ^ want) <= 3


def test_near_copies_weigh_as_one(sample_docs):
    """A third of a language in near copies: the band is close to the one without."""
    docs = sample_docs.where("lang = 'en'").dropDuplicates(["text"]).select("doc_id", "text", "lang")
    one = docs.where("length(text) > 1500").orderBy("doc_id").limit(1)
    near = (one.withColumn("doc_id", F.explode(F.sequence(F.lit(10 ** 6), F.lit(10 ** 6 + 99))))
            .withColumn("text", F.concat("text", F.lit(" copy number "), F.col("doc_id").cast("string"))))
    scored = [(k, float(k % 40) / 100 + 0.5, k) for k in range(120)] + [(10 ** 6 + k, 0.2 + k / 10 ** 4, 7) for k in range(100)]
    rows = docs.sparkSession.createDataFrame(scored, "mark long, log10_ppl double, sketch long").withColumns(
        {"lang": F.lit("en"), "base_failed": F.lit(False)})
    band, plain = (quality_rules.bands(x, 3.0, 0.03).first() for x in (rows, rows.where("mark < 1000000")))
    assert abs(band["lower"] - plain["lower"]) < 0.1 and abs(band["upper"] - plain["upper"]) < 0.1
    sketches = {r["sketch"] for r in quality_rules._by_arrays(
        near.withColumn("mark", F.lit(0).cast("long")), quality_rules.fit(docs, 2), 2).collect()}
    assert len(sketches) < 10
