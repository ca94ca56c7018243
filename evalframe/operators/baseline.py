"""A learned text baseline with Spark ML: TF-IDF of words and word pairs, balanced logistic regression."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import once
from .dataset import prefix_digest


NOT_ASCII = re.compile(r"[^\x00-\x7F]")
ASCII = r"^\p{ASCII}*$"


@F.pandas_udf(StringType())
def _bare(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else NOT_ASCII.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", t)))


def strip_accents(text: Column) -> Column:
    """NFKD without combining characters; texts of ASCII alone stay in the JVM."""
    plain = text.rlike(ASCII)
    return F.when(plain, text).otherwise(_bare(F.when(~plain, text)))


def words(text: Column) -> Column:
    """Lower-cased words of two characters and more, without accents. Unicode's word classes cost several times ASCII's."""
    found = lambda t, flags: F.regexp_extract_all(t, F.lit(rf"{flags}\b\w\w+\b"), F.lit(0))
    return once(strip_accents(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.when(t.rlike(ASCII), found(t, "")).otherwise(found(t, "(?U)")))


def with_pairs(found: Column) -> Column:
    """Words, and after them neighbouring pairs. found is named several times: a column, not an expression."""
    fewer = F.greatest(F.size(found) - 1, F.lit(0))
    return F.concat(found, F.zip_with(F.slice(found, 1, fewer), F.slice(found, 2, fewer), lambda a, b: F.concat(a, F.lit(" "), b)))


def grams(text: Column) -> Column:
    """Words and neighbouring pairs of a text."""
    return once(words(text), with_pairs)


#: Rows of the fit that one task goes through in each iteration; with few rows each core has a task.
ROWS_A_TASK, FEW = 20_000, 1_000


class TextBaseline:
    def __init__(self, counts: CountVectorizerModel, idf: list[float], model: LogisticRegressionModel, labels: list[str], identity: str) -> None:
        self.counts, self.idf, self.model, self.labels, self.identity = counts, idf, model, labels, identity

    @staticmethod
    def _weigh(df: DataFrame, idf: list[float]) -> DataFrame:
        """1 + ln(count) times idf, to length 1; vectors stay sparse."""
        scale = np.array(idf)

        def weigh(tf):
            at, counts = (tf.indices, tf.values) if isinstance(tf, SparseVector) else (np.flatnonzero(tf.toArray()), tf.toArray()[tf.toArray() > 0])
            x = (1 + np.log(counts)) * scale[at]
            return SparseVector(tf.size, at, x / max(np.linalg.norm(x), 1e-300))

        return df.withColumn("features", F.udf(weigh, VectorUDT())("tf")).drop("tf")

    @classmethod
    def fit(cls, df: DataFrame, text: str, label: str, vocabulary: int = 20_000, max_iter: int = 1_000) -> TextBaseline:
        """Needs two labels at least. identity: prefix_digest of the texts' digests with their labels."""
        rows = df.select(F.sha2(text, 256).alias("text"), F.col(label).cast("string").alias("label"), words(F.col(text)).alias("words")).where("label IS NOT NULL").persist()
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a closed vocabulary
        if len(sizes) < 2:
            raise ValueError("two labels at least are needed")
        labels, n = sorted(sizes), sum(sizes.values())
        listed = rows.select("label", with_pairs(F.col("words")).alias("grams"))
        common = listed.select(F.explode("grams").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(vocabulary)  # ties by the gram
        counts = CountVectorizerModel.from_vocabulary([r["g"] for r in common.collect()], inputCol="grams", outputCol="tf")
        identity = prefix_digest(rows.select(F.sha2(F.concat_ws("\n", "text", "label"), 256).alias("k")), "k").first()["digest"]
        cores = df.sparkSession.sparkContext.defaultParallelism
        tasks = max(-(-n // ROWS_A_TASK), min(-(-n // FEW), cores))  # each of the many iterations is a job: no task should be tiny
        tf = counts.transform(listed).select("label", "tf").repartition(tasks).persist()
        idf = [math.log((1 + n) / (1 + d)) + 1 for d in IDF(inputCol="tf").fit(tf).docFreq]
        rows.unpersist()
        table = F.create_map(*(F.lit(x) for k in labels for x in (k, float(labels.index(k)))))
        weight = F.create_map(*(F.lit(x) for k in labels for x in (k, n / (len(labels) * sizes[k]))))
        ready = cls._weigh(tf, idf).select("features", F.element_at(table, F.col("label")).alias("y"), F.element_at(weight, F.col("label")).alias("c"))
        model = LogisticRegression(labelCol="y", weightCol="c", maxIter=max_iter, regParam=1.0 / n, standardization=False).fit(ready)  # caches its own blocks
        tf.unpersist()
        return cls(counts, idf, model, labels, identity)

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """df plus predicted_label and predicted_confidence."""
        out = self.model.transform(self._weigh(self.counts.transform(df.withColumn("words", words(F.col(text))).withColumn("grams", with_pairs(F.col("words")))), self.idf))
        named = F.element_at(F.array(*map(F.lit, self.labels)), (F.col("prediction") + 1).cast("int"))
        return out.withColumns({"predicted_label": named, "predicted_confidence": F.array_max(vector_to_array("probability"))}).drop("words", "grams", "features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.counts.write().save(f"{path}/counts")
        self.model.write().save(f"{path}/model")
        spark = SparkSession.active()
        spark.createDataFrame([(self.idf, self.labels, self.identity)], "idf array<double>, labels array<string>, identity string").write.json(f"{path}/rest")

    @classmethod
    def load(cls, spark, path: str) -> TextBaseline:
        rest = spark.read.schema("idf array<double>, labels array<string>, identity string").json(f"{path}/rest").first()
        return cls(CountVectorizerModel.load(f"{path}/counts"), list(rest["idf"]), LogisticRegressionModel.load(f"{path}/model"), list(rest["labels"]), rest["identity"])
