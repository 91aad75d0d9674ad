"""Labelled data preparation, classifier training and evaluation.

Metrics are one global aggregate (partial per partition); training is a Spark
ML pipeline per language, the re-aim of the reference's transformer
fine-tuning loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import filters, ranking
from newsloom.operators.ngrams import words
from newsloom.session import ensure_checkpoint_dir

# Label ids.
LABEL2ID = {"positive": 0, "negative": 1, "neutral": 2}
ID2LABEL = {v: k for k, v in LABEL2ID.items()}
PAD = "[PAD]"


def label_map() -> Column:
    return F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(k), F.lit(v))])


def label_ids(df: DataFrame, label_col: str = "label", out: str = "label_id") -> DataFrame:
    """Label text -> id through a literal map; unmapped labels dropped."""
    return df.withColumn(out, F.element_at(label_map(), F.lower(F.col(label_col)))).filter(F.col(out).isNotNull())


def prepare_label_sample(df: DataFrame, n_per_lang: int, languages: Sequence[str], seed: int = 42) -> DataFrame:
    """B15 + B12 + F8 + G3 + F4: balanced sample for labelling with ids 1..N and an empty label."""
    filters.require_columns(df, ["source", "language", "category", "text"])
    clean = filters.drop_short_text(df.filter(F.col("language").isin(*languages)), "text", 30)
    sample = ranking.balanced_sample(clean, "language", n_per_lang, id_col="doc_key", seed=seed)
    ordered = ranking.sequential_ids(sample, [F.col("language"), F.col("sample_rank")], col="id")
    return ordered.select("id", "source", "language", "category", "text", F.lit("").alias("label"))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                           classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Accuracy and macro-F1 (zero division -> 0) in one aggregate."""
    y, p = F.col(label_col), F.col(pred_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("correct")]
    for c in classes:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(y == c).alias(f"sup{c}"),
                 F.count_if(p == c).alias(f"pp{c}")]
    m = df.agg(*aggs)
    f1s = []
    for c in classes:
        prec = F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"pp{c}")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"sup{c}")), F.lit(0.0))
        f1s.append(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)))
    macro = sum(f1s[1:], f1s[0]) / F.lit(len(classes))
    return m.select("n", F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0)), 6).alias("accuracy"),
                    F.round(macro, 6).alias("macro_f1"))


def tokenize_fixed(text: Column, max_length: int = 128) -> Column:
    """K8: lower-cased word tokens truncated or padded to ``max_length``."""
    toks = F.slice(words(text), 1, max_length)
    return F.concat(toks, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_length) - F.size(toks), F.lit(0))))


def attention_mask(text: Column, max_length: int = 128) -> Column:
    n = F.least(F.size(words(text)), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


def token_features(df: DataFrame, text_col: str = "text", num_features: int = 1 << 18) -> DataFrame:
    """K7: add the hashed term counts ``tf`` (RegexTokenizer -> HashingTF; nothing is fitted here)."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tokens = RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=r"[\p{L}\p{N}_]+", gaps=False, toLowercase=True)
    return HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features).transform(tokens.transform(df))


def sentiment_classifier_spec(max_iter: int = 50, reg: float = 0.01):
    """K7: IDF -> multinomial LogisticRegression over hashed term counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    return Pipeline(stages=[
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_id", predictionCol="prediction",
                           family="multinomial", maxIter=max_iter, regParam=reg,
                           # Gradients are dense (classes x features), so few of them may reach the driver at a time.
                           aggregationDepth=4),
    ])


def train_and_evaluate(df: DataFrame, languages: Sequence[str], text_col: str = "text", label_col: str = "label",
                       id_col: str = "id", seed: int = 42) -> DataFrame:
    """K7 + F9 + E18: per language, hash-split 80/20, fit on train, score test, report metrics.

    One distributed fit per language, submitted from a small thread pool.
    """
    data = label_ids(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                               F.col(label_col).alias("label"), "language"), "label").withColumn(
        "label_id", F.col("label_id").cast("double"))
    ensure_checkpoint_dir(df.sparkSession)
    # One pass over the texts: hashed term counts, written once and read by every fit.
    data = (token_features(ranking.split_train_test(data, "id", seed).filter(F.col("text").isNotNull()))
            .select("language", "split", "label_id", "tf").checkpoint(eager=True))
    trained = {r["language"]: r["n"] for r in data.filter(F.col("split") == "train").groupBy("language").agg(
        F.count(F.lit(1)).alias("n")).collect()}   # one row per language

    def fit_one(lang: str) -> DataFrame:
        part = data.filter(F.col("language") == lang)
        train = part.filter(F.col("split") == "train")
        test = part.filter(F.col("split") == "test")
        model = sentiment_classifier_spec().fit(train)
        scored = model.transform(test).select(F.col("label_id").cast("int").alias("label"),
                                              F.col("prediction").cast("int").alias("pred"))
        met = classification_metrics(scored).withColumn("language", F.lit(lang))
        return met.withColumn("n_train", F.lit(trained[lang]).cast("long")).checkpoint(eager=True)

    # The per-language fits are independent Spark jobs: submit them concurrently.
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(4, len(languages)))) as pool:
        rows = list(pool.map(fit_one, languages))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("language", "n_train", F.col("n").alias("n_test"), "accuracy", "macro_f1")
