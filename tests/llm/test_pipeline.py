import brute
from kindler.llm import common, stages


def test_stages_against_brute_force(spark, frame, docs, monkeypatch):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    columns = frame.columns
    unique = common.written(stages.near_duplicates(spark, frame.unionByName(frame.where("doc_id in (5, 12)")), ""))
    assert unique.columns == columns
    kept = [(d, t) for d, t in docs if brute.near_duplicates(docs)[d][1] == d]
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(d for d, _ in kept)
    cut = common.written(stages.substring_dedup(spark, unique, ""))
    assert cut.columns == columns
    want = {d: (t if not n else k) for (d, t), (_, _, n, k) in zip(kept, brute.substring_dedup(kept), strict=True)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    bench = [(1, want[16][5000:5200])]
    monkeypatch.setattr(stages, "table", lambda s, d, n: spark.createDataFrame(bench, "item_id long, text string"))
    clean = stages.benchmark_decontamination(spark, cut, "")
    assert clean.columns == columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _, hit, _ in brute.decontaminate(list(want.items()), bench) if not hit)


def test_texts_that_share_an_id_are_judged_apart(spark):
    """A copy of one text of id 1 goes, whichever text of that id is kept first; null ids give way to others."""
    text = lambda seed: " ".join(f"w{seed}x{k}" for k in range(40))
    near = text("a").replace("ax39", "changed")
    rows = [(1, text("a")), (1, text("b")), (31, near), (None, text("b")), (None, text("c")), (None, text("c")), (None, None), (4, ""), (5, " "), (5, " "), (6, text("d"))]
    got = stages.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, None), (4, ""), (5, " "), (6, text("d"))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pipeline_runs_and_keeps_clean_documents(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    good = P.STAGES[0][1](spark, docs, folder)
    labels = common.table(spark, folder, "labels")
    both = docs.join(labels, "doc_id").where("quality = 1")
    assert good.columns == docs.columns
    assert good.join(both.select("doc_id"), "doc_id").count() >= 0.95 * both.count()
    rows = P.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
