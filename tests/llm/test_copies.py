"""Copies that cut lineages."""

from __future__ import annotations

from driftwood.llm import jaccard_join, lines, passages
from driftwood.llm._common import copied


def test_a_copy_computes_its_rows_once_and_is_the_same(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(found):
        for batch in found:
            seen.add(batch.num_rows)
            yield batch

    got = copied(spark.range(100).selectExpr("id", "array(id, null) AS a", "cast(id AS binary) AS b").mapInArrow(run, "id bigint, a array<bigint>, b binary"))
    assert sorted(r["a"][0] for r in got.collect()) == list(range(100)) and seen.value == 100
    assert copied(got.where("id < 0")).schema == got.schema and copied(got.where("id < 0")).isEmpty()


def test_the_joins_of_lines_and_documents_use_such_copies():
    assert jaccard_join.copied is copied and lines.copied is copied


def test_slices_of_passages_leave_no_copies_but_their_own(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(i, f"{text} own{i}") for i in range(4)], "doc_id bigint, text string")
    made = []
    monkeypatch.setattr(passages, "copied", lambda df: made.append(copied(df)) or made[-1])
    monkeypatch.setattr(passages, "SLICE", 150)
    assert passages.repeated_passages(docs).count() == 6
    fs = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    left = [any(fs(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(f)) for f in df.inputFiles()) for df in made]
    slices = (len(made) - 3) // 4
    assert slices > 1 and left == [True, True, False] + [False, False, False, True] * slices
