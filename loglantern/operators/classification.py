"""Weak labels, training rows, the one-vs-rest classifier, and its measures."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import taxonomy, text, vectors
from ..session import scratch_path
from .ranking import newest
from .reports import counts_by, with_share

# Newest vectors taken for training, share and seed of the split, and the classifier's settings.
# Fixed values.
TRAINING_ROWS = 200_000
TRAIN_SHARE = 0.8
SEED = 42
MAX_ITERATIONS = 2000
INVERSE_PENALTY = 1.0
# The split counts rows by the hash without its last bits first.
HASH_BITS = 48


# -- rows -------------------------------------------------------------------------------------

def with_label(df: DataFrame, message: str = "message", lists: taxonomy.WordLists = taxonomy.LABEL_WORDS) -> DataFrame:
    return df.withColumn("label", taxonomy.label_of(message, lists))


def training_rows(embeddings: DataFrame, dim: int, limit: int | None = TRAINING_ROWS) -> DataFrame:
    """The newest rows, then of those the ones with a message and a vector of the right size, with
    their weak label. ``limit`` None takes the whole table."""
    rows = embeddings if limit is None else newest(embeddings, limit)
    usable = rows.filter(vectors.is_valid("embedding", dim) & text.not_empty("message"))
    return with_label(usable)


def label_distribution(labelled: DataFrame) -> DataFrame:
    return with_share(counts_by(labelled, "label")).orderBy("label")


def stratified_split(
    labelled: DataFrame, key: str = "log_id", share: float = TRAIN_SHARE, seed: int = SEED, label: str = "label"
) -> DataFrame:
    """Adds ``is_train``: the same share of every label, decided by a hash of the row key.

    The cut is the exact hash quantile of each label: rows are counted by label and first bits of the hash, and then by hash
    among those bits that hold the quantile. No label is ever gathered in one task. A retried task decides as before, and
    rows with the same key fall on the same side; where that side would be off by a row or more, the nearer one is taken.
    """
    hashed = labelled.withColumn("__hash", F.xxhash64(key, F.lit(seed)))
    # One row per label: a handful of names from the word lists.
    joined = hashed.join(F.broadcast(_hash_cuts(hashed.select(label, "__hash"), label, share)), label)
    return joined.withColumn("is_train", F.col("__hash") <= F.col("__cut")).drop("__hash", "__cut")


def _hash_cuts(hashed: DataFrame, label: str, share: float) -> DataFrame:
    """``__cut``: the greatest hash of each label's share."""
    hashed = hashed.withColumn("__bits", F.shiftright("__hash", HASH_BITS))

    def holding(counted: DataFrame, order: str, before: Column) -> DataFrame:
        """Of counts in that order the one that reaches the wanted row."""
        upto = F.sum("__n").over(Window.partitionBy(label).orderBy(order)) + before
        return counted.withColumn("__upto", upto).filter((F.col("__upto") >= F.ceil("__wanted")) & (F.col("__upto") - F.col("__n") < F.ceil("__wanted")))

    # At most 2 ** 16 counts per label.
    counted = hashed.groupBy(label, "__bits").agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__wanted", F.sum("__n").over(Window.partitionBy(label)) * F.lit(share))
    bits = holding(counted, "__bits", F.lit(0)).select(label, "__bits", (F.col("__upto") - F.col("__n")).alias("__before"), "__wanted")
    inside = hashed.join(F.broadcast(bits), [label, "__bits"])
    inside = inside.groupBy(label, "__hash", "__before", "__wanted").agg(F.count(F.lit(1)).alias("__n"))
    found = holding(inside, "__hash", F.col("__before"))
    over = F.col("__upto") - F.col("__wanted")
    beyond = (over >= 1) & (over > F.col("__n") - over)
    return found.select(label, (F.col("__hash") - beyond.cast("bigint")).alias("__cut"))


# -- classifier -------------------------------------------------------------------------------

def as_features(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Adds the ML vector column; training and prediction both go through here."""
    return df.withColumn("features", array_to_vector(vectors.normalize(embedding)))


def train_classifier(
    train: DataFrame,
    inverse_penalty: float = INVERSE_PENALTY,
    max_iterations: int = MAX_ITERATIONS,
    parallelism: int = 8,
) -> PipelineModel:
    """Standardise, then one penalised logistic regression per label.

    The penalty is divided by the number of rows because Spark averages the loss over them. The
    k fits read the same rows, so the rows are held on memory and disk meanwhile.
    """
    rows = as_features(train).select("features", "label").persist()
    try:
        n = max(rows.count(), 1)
        base = LogisticRegression(
            regParam=1.0 / (inverse_penalty * n),
            elasticNetParam=0.0,
            maxIter=max_iterations,
            standardization=False,
            featuresCol="scaled",
        )
        stages = [
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            OneVsRest(classifier=base, labelCol="label_index", featuresCol="scaled", parallelism=parallelism),
        ]
        fitted = Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()
    # A freshly fitted model carries its training summary, and with it the session, into every task.
    # Stored and loaded again it holds the coefficients alone, as any later user of it sees it.
    path = scratch_path(train.sparkSession, "classifier")
    fitted.save(path)
    return PipelineModel.load(path)


def classes_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``prediction`` and one ``proba_<class>`` column per class; the probabilities sum to 1.

    Each binary model gives the probability of its own class in the JVM; together they are scaled
    to sum to 1. The one-vs-rest wrapper itself would go through a Python function for every row.
    """
    classes = classes_of(model)
    scored = model.stages[1].transform(as_features(rows))
    for i, binary in enumerate(model.stages[2].models):
        binary = binary.copy().setFeaturesCol("scaled").setPredictionCol("")
        scored = binary.setRawPredictionCol("").setProbabilityCol(f"__p{i}").transform(scored)
    own = [vector_to_array(f"__p{i}")[1].alias(f"__own{i}") for i in range(len(classes))]
    scored = scored.select(*[F.col(c) for c in rows.columns], *own)
    total = sum((F.col(f"__own{i}") for i in range(1, len(classes))), F.col("__own0"))
    shares = [F.col(f"__own{i}") / total for i in range(len(classes))]
    return scored.select(
        *[F.col(c) for c in rows.columns],
        vectors.argmax(F.array(*shares), classes).alias("prediction"),
        *[share.alias(f"proba_{name}") for share, name in zip(shares, classes)],
    )


# -- measures ---------------------------------------------------------------------------------

def confusion_matrix(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by (label, prediction): at most the square of the number of classes."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_table(matrix: DataFrame, classes: list) -> DataFrame:
    """One row per true class and one column per known class, zero-filled."""
    return (
        matrix.groupBy("label").pivot("prediction", classes).agg(F.sum("count")).na.fill(0).orderBy("label")
    )


def accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def classification_report(matrix: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class with their plain and weighted means, and the
    accuracy as the F1 of its own row. A measure whose divisor is zero is 0.

    Made from the confusion counts alone in two small aggregations: every class row also enters
    the three summary rows.
    """
    equal = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(
            F.col("label").cast("string").alias("class"),
            F.col("count").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(equal, F.col("count")).otherwise(F.lit(0)).cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("prediction").cast("string").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("count").alias("predicted"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    sums = (
        matrix.select(F.explode(sides).alias("s"))
        .groupBy("s.class")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    measured = sums.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("support"))
    )
    total = F.col("precision") + F.col("recall")
    measured = measured.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), total))
    names = F.array(F.col("class"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    spread = measured.select("*", F.posexplode(names).alias("part", "name"))
    weight = F.when(F.col("part") == 3, F.col("support").cast("double")).otherwise(F.lit(1.0))
    spread = spread.withColumn("w", weight)

    def mean(measure: str):
        return ratio(F.sum(F.col(measure) * F.col("w")), F.sum("w"))

    of_all = F.col("part") == 1
    hit_share = ratio(F.sum("hits").cast("double"), F.sum("support").cast("double"))
    return (
        spread.groupBy("part", "name")
        .agg(
            F.when(~of_all, F.round(mean("precision"), digits)).alias("precision"),
            F.when(~of_all, F.round(mean("recall"), digits)).alias("recall"),
            F.round(F.when(of_all, hit_share).otherwise(mean("f1")), digits).alias("f1"),
            F.sum("support").alias("support"),
        )
        .select("name", "precision", "recall", "f1", "support")
    )
