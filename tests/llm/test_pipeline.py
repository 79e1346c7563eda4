"""The pipeline's stages on a small table, and the registered queries."""

import corpus_pipeline
from stormcell.llm import catalog, ngram_join, passages, quality_rules


def test_stages(spark, tmp_path):
    import random
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(90), text(60)
    texts = [text(60) for _ in range(40)] + [base, base, base + " more"] + [f"{text(80)} {passage}" for _ in range(3)] \
        + ["short text", None] + ["SHOUT!! | ### " * 12 + text(12).upper()]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 46), 0) for i in range(49)], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    names, frames = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/{name}"
        stage(spark, frames[-1], sf).write.parquet(path)
        frames.append(spark.read.parquet(path))
        if name != names[-1]:
            assert frames[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert ids[1] == kept and 46 not in kept and 47 not in kept
    comps = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frames[1]).collect()}
    assert ids[2] == {i for i, c in comps.items() if c == i} and 41 not in ids[2] and 42 not in ids[2]
    gone = {r["doc_id"]: r["n_removed"] for r in passages.passage_digest(frames[2]).collect()}
    after = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    for r in frames[2].collect():
        assert len(r["text"].split()) - len(after[r["doc_id"]].split()) == gone[r["doc_id"]]
    assert sum(gone.values()) >= 120
    assert ids[4] == ids[3] == ids[5]
    assert corpus_pipeline.run(spark, sf).count() == frames[5].count()


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 14))
    assert set(catalog.SQL) <= set(catalog.QUERIES)
