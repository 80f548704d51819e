"""Each drafted sentence meets every hit."""

from pyspark.sql import functions as F

from orrery.operators import retrieval


def test_best_premise_among_many_hits(spark):
    hits = spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") + 10).alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("id").isin(5, 1500, 2999), F.concat(F.lit("rare premise "), F.col("id"))).otherwise("nothing here").alias("text"))
    sentences = spark.createDataFrame([(f"rare premise {k}",) for k in (5, 1500, 2999)] + [("rare premise",)], "sentence string")
    got = {r.sentence: (r.best_doc_id, r.entailment) for r in retrieval.nli_scores(sentences, hits).collect()}
    assert got == {"rare premise 5": (15, 1.0), "rare premise 1500": (1510, 1.0), "rare premise 2999": (3009, 1.0), "rare premise": (15, 1.0)}
