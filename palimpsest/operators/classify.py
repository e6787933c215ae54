"""Document types by a trained text classifier, with the keyword types as fallback."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T
from palimpsest.llm.common import bound_batches

LEAST_CONFIDENCE = 0.45
VOCABULARY = 5000


def train(corpus: DataFrame, text: str = "text", label: str = "label", c: float = 5.0, rounds: int = 200) -> PipelineModel:
    """Term frequencies with smoothed inverse document frequencies, unit length, multinomial logistic regression."""
    bound_batches(corpus.sparkSession)
    rows = corpus.select(T.classifier_text(F.coalesce(text, F.lit(""))).alias("clean"), F.col(label).cast("string").alias("label")).where("clean <> ''").persist()
    try:
        n = rows.count()
        words = RegexTokenizer(inputCol="clean", outputCol="words", pattern=r"\b\w\w+\b", gaps=False)
        counts = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=VOCABULARY).fit(words.transform(rows))
        held = words.transform(rows).select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
        of = {r["w"]: r["count"] for r in held.join(F.broadcast(corpus.sparkSession.createDataFrame([(w,) for w in counts.vocabulary], "w string")), "w").collect()}
        idf = [float(_log((1 + n) / (1 + of[w])) + 1) for w in counts.vocabulary]
        weigh = ElementwiseProduct(inputCol="counts", outputCol="weighed", scalingVec=Vectors.dense(idf))
        unit = Normalizer(inputCol="weighed", outputCol="features", p=2.0)
        index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep")
        regression = LogisticRegression(featuresCol="features", labelCol="target", regParam=1 / (c * n), standardization=False, family="multinomial", maxIter=rounds)
        return Pipeline(stages=[words, counts, weigh, unit, index, regression]).fit(rows)
    finally:
        rows.unpersist()


def _log(x: float) -> float:
    from math import log

    return log(x)


def classify(docs: DataFrame, model: PipelineModel, text: str = "text", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Add label, model_confidence, all_scores and model_type (``unknown`` below ``least``; null for empty text).

    Labels without a document type count as ``other``; the last of them keeps its score.
    """
    bound_batches(docs.sparkSession)
    labels = model.stages[4].labels
    regression: LogisticRegressionModel = model.stages[5]
    types = [C.LABEL_TYPES.get(x, "other") for x in labels]
    last = {t: i for i, t in enumerate(types)}
    rows = docs.withColumn("clean", T.classifier_text(F.coalesce(text, F.lit(""))))
    for stage in model.stages[:4]:
        rows = stage.transform(rows)
    p = vector_to_array("probability")
    rows = regression.transform(rows).withColumn("_p", F.slice(p, 1, len(labels)))
    rows = rows.withColumn("_best", F.array_position("_p", F.array_max("_p")).cast("int"))
    rows = rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.col("_best"))).withColumn("model_confidence", F.bround(F.array_max("_p"), 4))
    rows = rows.withColumn("all_scores", F.create_map(*[x for t, i in last.items() for x in (F.lit(t), F.bround(F.get("_p", F.lit(i)), 4))]))
    of_label = F.element_at(F.array(*map(F.lit, types)), F.col("_best"))
    kind = F.when(F.col("clean") == "", None).when(F.array_max("_p") < least, "unknown").otherwise(of_label)
    return rows.withColumn("model_type", kind).drop("clean", "words", "counts", "weighed", "features", "rawPrediction", "probability", "prediction", "_p", "_best")


class NotReady(RuntimeError):
    """There is no stored classifier."""


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    """The classifier stored at ``path``, on any file system that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise NotReady(f"no classifier is stored at {path}")
    return PipelineModel.load(path)


def stored_or_none(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add model_type and model_confidence by the classifier at ``path``; nulls where it is missing or the text is empty."""
    try:
        model = load(rows.sparkSession, path)
    except NotReady:
        return rows.withColumns({"model_type": F.lit(None).cast("string"), "model_confidence": F.lit(None).cast("double")})
    return classify(rows, model, text)


def with_fallback(rows: DataFrame) -> DataFrame:
    """document_type and confidence of the classifier where it has an answer, else those of the keywords."""
    some = F.col("model_type").isNotNull()
    return rows.withColumn("confidence", F.when(some, F.col("model_confidence")).otherwise(F.col("confidence"))).withColumn("document_type", F.coalesce("model_type", "document_type"))


def evaluate(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of each class, and the accuracy."""
    counts = rows.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    said = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    each = counts.groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    rows = each.join(said, "class", "full").na.fill(0).crossJoin(F.broadcast(total))
    precision, recall = F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("class", "support", F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(f1, 4).alias("f1"), F.bround(F.try_divide("right", "total"), 4).alias("accuracy"))
