"""Pipeline stages on documents with columns of any names, long and empty texts, and empty tables."""

import random

import corpus_pipeline

EXTRA = ("spans", "_blob", "_changed", "_content", "size", "copies", "taken", "score", "row", "digest", "key", "hash", "doc", "changed")


def test_stages_keep_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter"]) for _ in range(4))
    texts = [" ".join(word() for _ in range(30)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (None, " ".join(word() for _ in range(40_000)), "en", "s1", 1),
             (3, texts[3], "en", "s1", len(texts[3])), (22, texts[4] + " token: abcdef123456", "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr(
        "*", *(f"concat('{c}', doc_id) AS {c}" for c in EXTRA)).repartition(3)
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[0])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        want = docs.columns + (["mix_size", "mix_copies", "mix_taken"] if name == "mixing" else [])
        assert out.columns == want, name
        out.write.parquet(f"{tmp_path}/out_{name}")
        found = spark.read.parquet(f"{tmp_path}/out_{name}").collect()
        kept[name] = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found)
        assert all(r[c] is None if r["doc_id"] is None else r[c] == f"{c}{r['doc_id']}" for r in found for c in EXTRA), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    everything = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert kept["toxicity"] == kept["secrets"] == everything
    assert len(kept["near_duplicates"]) == len(rows) - 2 and kept["decontamination"] == [k for k in everything if k != (True, 0)]
