"""The pipeline's stages against each other."""

import corpus_pipeline
from wayfold.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.persisted(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns, name
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before and out.count() == len(after)
        kept.append(after)
        if name.startswith("quality"):
            assert after == {r["doc_id"] for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == kept[-1] and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in last)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept[-1]


def test_near_duplicate_stage_keeps_one_of_a_group_and_equal_rows_once(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(3, base), (5, base + " end"), (3, base), (7, "quite another text with words of its own"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "7", "None"]


def test_near_duplicate_stage_judges_rows_without_an_id_too(spark):
    """Copies, near copies and empty texts among them leave one row each, and no row with an id goes or stays by them."""
    base = [" ".join(f"{c}{k}" for k in range(200)) for c in "wz"]
    step = [" ".join(f"s{k}" for k in range(i, i + 120)) for i in (0, 9, 18)]  # the ends are alike by the one between only
    rows = [(None, base[0]), (None, base[0]), (None, base[0] + " end"), (None, base[1]), (None, ""), (None, None), (3, base[0]), (4, step[0]), (None, step[1]), (5, step[2])]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [3, 4, 5]
    left = [r["text"] or "" for r in out if r["doc_id"] is None]
    assert len(left) == 4 and {x[:1] for x in left} == {"w", "z", "s", ""}


def test_near_duplicate_stage_judges_each_text_by_itself_where_ids_repeat(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(4, base), (9, base + " end"), (9, " ".join(f"z{k}" for k in range(90)))]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string"), SF).collect()
        assert sorted((r["doc_id"], r["text"]) for r in out) == [rows[0], rows[2]]


def test_stages_take_odd_rows_and_empty_tables(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing names through every stage; then no rows at all."""
    docs = odd.selectExpr("doc_id", "text", "n_tokens as removed_lines", "'x' as first_id", "'y' as bench_items")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns
            frame = corpus_pipeline.common.persisted(out, "test-odd")
        rows = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
        assert len(rows) == frame.count() and all(r["round_trip"] for r in rows)
        assert not rows or {r["doc_id"] for r in rows} >= {None, 1, 4, 5, 6, 7}
        kept = corpus_pipeline.quality(spark, frame, SF)
        assert kept.columns == frame.columns and kept.count() <= len(rows)
