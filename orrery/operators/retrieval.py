"""Retrieval: vector index, exact search, extractive drafts, verification, coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as T

EPSILON = 1e-9


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(inner_product(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v)


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows with the largest inner product; ties by key. The query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, inner_product(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hashed_embedding(x: Column, dim: int = 64) -> Column:
    """A bag of words in dim hashed places: a stand-in where no model is at hand."""
    places = F.transform(T.rag_tokens(x), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("float"))


def embedded(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text", column: str = "embedding") -> DataFrame:
    """chunks with vectors from a model (called with lists of texts), or from hashed words."""
    if model is None:
        return chunks.withColumn(column, hashed_embedding(F.col(text)))
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{column: model(pdf[text].fillna("").tolist())})

    return chunks.mapInPandas(run, StructType([*chunks.schema.fields, StructField(column, ArrayType(FloatType()))]))


def attach_kg_nodes(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunks with the sorted distinct nodes of their document; none: an empty list."""
    found = links.groupBy("doc_sha256").agg(F.array_sort(F.collect_set(F.col("kg_node_id").cast("string"))).alias("kg_nodes"))
    return chunks.join(found, "doc_sha256", "left").withColumn("kg_nodes", F.coalesce("kg_nodes", F.array().cast("array<string>")))


def with_chunk_ids(chunks: DataFrame, order: str) -> DataFrame:
    """chunks with chunk_id = hash:page:number within the page."""
    n = F.row_number().over(Window.partitionBy("doc_sha256", "page").orderBy(order)) - 1
    return chunks.withColumn("chunk_id", F.concat_ws(":", F.substring("doc_sha256", 1, 12), F.col("page"), n))


def draft(hits: DataFrame, query: str, most: int = 4, text: str = "text", pos: str = "pos") -> DataFrame:
    """The sentences of hits that resemble the query most, without near repeats."""
    asked = T.rag_tokens(F.lit(query))
    rows = hits.select(pos, F.posexplode(T.rag_sentences(F.col(text))).alias("n", "sentence")).withColumn("tokens", T.rag_tokens(F.col("sentence")))
    rows = rows.withColumns({"score": T.smoothed_jaccard(asked, F.col("tokens")), "repeat_key": F.substring(F.array_join("tokens", " "), 1, 80)}).filter("score > 0")
    best = Window.partitionBy("repeat_key").orderBy(F.desc("score"), pos, "n")
    kept = rows.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    return kept.orderBy(F.desc("score"), pos, "n").limit(most).select(pos, "n", "sentence", "score")


def nli_scores(sentences: DataFrame, hits: DataFrame, score: Callable[[Column, Column], tuple[Column, Column]] | None = None, premise_chars: int = 1200) -> DataFrame:
    """Each sentence's best premise among the hits: entailment, contradiction, doc_id, page; ties go to the earlier hit.

    The drafts of a question are a handful and are sent to all hits, of which each is scored.
    Without a model entailment is the share of the sentence's tokens that the premise has, and
    contradiction is the rest at one half.
    """
    if score is None:

        def score(s, p):
            a, b = T.rag_tokens(s), T.rag_tokens(p)
            share = F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(F.lit(0.0))
            return share, (1 - share) / 2

    pairs = hits.select("pos", "doc_id", "page", "text").join(F.broadcast(sentences.select("sentence").distinct()), F.lit(True))
    ent, con = score(F.col("sentence"), F.substring("text", 1, premise_chars))
    pairs = pairs.withColumns({"entailment": ent, "contradiction": con})
    best = F.max_by(F.struct("entailment", "contradiction", F.col("doc_id").alias("best_doc_id"), F.col("page").alias("best_page")), F.struct("entailment", -F.col("pos")))
    return pairs.groupBy("sentence").agg(best.alias("b")).select("sentence", "b.*")


def accepted(nli: DataFrame, entailment: float = 0.55, contradiction: float = 0.30) -> DataFrame:
    return nli.filter((F.col("entailment") >= entailment) & (F.col("contradiction") <= contradiction))


def coverage(sentences: DataFrame, nli: DataFrame, key: str = "id") -> DataFrame:
    """Share of tokens whose sentence is entailed and not contradicted, by key.

    A sentence without a score counts as not entailed; of several the largest entailment stands.
    """
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    best = nli.groupBy("sentence").agg(F.max_by(F.struct("entailment", "contradiction"), "entailment").alias("b")).select("sentence", "b.*")
    rows = sentences.withColumn("tokens", F.size(T.rag_tokens(F.col("sentence")))).join(best, "sentence", "left")
    good = F.col("tokens") * clip(F.coalesce("entailment", F.lit(0.0))) * clip(1 - F.coalesce("contradiction", F.lit(1.0)))
    return rows.groupBy(key).agg(clip(F.sum(good) / (F.sum("tokens") + EPSILON)).alias("coverage"))


def gated(scores: DataFrame, least: float = 0.6) -> DataFrame:
    """scores with status ok or needs_clarification."""
    return scores.withColumn("status", F.when(F.col("coverage") < least, "needs_clarification").otherwise("ok"))


def ordered_distinct(hits: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """Distinct values in the order in which they first occur."""
    return hits.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(pos).alias("first")).orderBy("first")


def as_list(x: Column) -> Column:
    """A JSON list as an array, any other text as a list of one."""
    return F.coalesce(F.from_json(F.when(x.startswith("["), x), "array<string>"), F.when(x.isNotNull(), F.array(x)))
