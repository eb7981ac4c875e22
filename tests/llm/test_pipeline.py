"""The corpus pipeline over a small table, each stage's decisions checked against its input."""

from __future__ import annotations

import random


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["th", "er", "on", "ing", "an", "re"], k=3))
    make = lambda n: " ".join(word() + str(rng.randrange(9)) for _ in range(n))
    item = make(40)
    texts = [make(80) for _ in range(20)]
    near = texts[3].split(" ")
    near[40] = "changed"
    texts += [texts[0], " ".join(near), make(30) + " " + item + " " + make(30), None, "", "12 34", make(40) + "\n" + texts[5] + "\n" + make(30)]
    spark.createDataFrame([(i, t, "en" if i % 4 else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "byte_bpe"]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(20), 26}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.values())
    assert out[26]["n_chars"] == len(texts[26]) - len(texts[5]) - 1
    assert {r["lang"] for r in out.values()} == {"en"}
