"""The pipeline stage by stage against what each stage's operator says about its own input."""

from collections import defaultdict

import corpus_pipeline
import test_jaccard
from pyspark.sql import functions as F

from tagweave.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit("extra"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, FOLDER).cache()
    assert kept.columns == docs.columns
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    assert ids(kept) == ids(scored.where("predicted = 0"))
    good = stages["quality_classifier"](spark, kept, FOLDER).cache()
    scored = quality.score_quality(kept, quality.train_quality(kept, labels))
    assert ids(good) == ids(scored.where("predicted = 1")) and good.columns == docs.columns
    once = stages["ngram_jaccard_join"](spark, good, FOLDER).cache()
    want = test_jaccard.brute([(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    assert ids(once) == sorted({c for _, c, _ in want}) and once.columns == docs.columns
    packed = stages["best_fit_packing"](spark, once, FOLDER)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(once)
    kept.unpersist()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    room = defaultdict(int)
    for r in rows:
        room[r.sequence_id] += r.length
    assert rows and max(room.values()) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
