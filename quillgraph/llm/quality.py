"""Quality classifier: document evidence combined with hierarchical empirical Bayes site posteriors.

Evidence: a ridge-penalised logistic regression over layout, repetition and character features, fitted
in numpy to at most ``max_labelled`` labelled documents, chosen by their id's hash.

Sites: a source is a host and a language in it a path. Over all documents, each host and path sums
good evidence (its label where a document has one, else the classifier's probability). A host's rate is
shrunk towards the global rate and a path's towards its host's, each as a beta posterior whose
strength is estimated by moments from how far rates at that level spread beyond sampling noise; sparse
sites stay near their prior. A document's prior leaves its own evidence out of all three sums, so
nothing is counted twice. Its posterior log-odds are its classifier log-odds, less the log-odds of the
training rate, plus those of its prior. Documents at or above ``threshold`` are kept.

Every text is measured once; what follows works on the written scores. Sums are grouped before they are
shuffled, one row per path and task, so a hot source is no hot task. Site sums and labels are counted
and broadcast while there are at most ``max_broadcast`` of them, else joined by shuffling, where
adaptive execution splits hot keys.

Defined results: null texts are empty; empty texts get features of 0 and a probability like any other;
a null source or language is a site of its own; without labels of both values the classifier is
neutral; an empty table gives an empty result; other columns are kept or not read; repeated rows of a
document are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, materialize, some_rows

_SYMBOL = re.compile(r"[^\w\s]")
_SIGN_TAIL = re.compile(r"[^\w\s.,;:!?'\")-]\B|[!?]{2,}")
FEATURES = 14


def features(text: str) -> list[float]:
    """Layout, repetition and character measures of a whole text."""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text))
    symbols = len(_SYMBOL.findall(text))
    tails = len(_SIGN_TAIL.findall(text))
    pairs = Counter(zip(words, words[1:]))
    return [
        np.log1p(n), letters / n / 10, symbols / letters, tails / n, text.count("|") / n, upper / letters,
        sum(1 for w in words if w.isdigit()) / n, len(counts) / n, counts.most_common(1)[0][1] / n,
        len({*lines}) / len(lines), np.log1p(n / len(lines)), 1 - len(pairs) / max(1, n - 1), text.count("!") / n,
        sum(1 for w in words if len(w) == 1) / n,
    ]


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features, their squares and an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.neutral = not len(y) or y.min() == y.max()
        if self.neutral:
            self.rate = 0.5
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, w = self._design(x), None
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.neutral or not len(x) else np.clip(self._design(x) @ self.w, -12, 12)


def _labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__qg_id")).agg(F.max(F.col(label).cast("double")).alias("__qg_y"))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000) -> Logistic:
    """Fit the classifier to at most ``max_labelled`` labelled documents; their ids are broadcast, no text is shuffled for them."""
    arrow_rows(df.sparkSession)
    known = _labels(labels, key, label)
    known = some_rows(known, "__qg_id", max_labelled // 2, known.count())
    rows = df.select(F.col(f"`{key}`").alias("__qg_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__qg_t")).join(F.broadcast(known), "__qg_id")

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    # in one order, so that sums round alike and repeated ids cannot pass the bound at random
    got = rows.select("__qg_y", measure("__qg_t").alias("x"), F.xxhash64("__qg_id", "__qg_t").alias("h")).orderBy("h").limit(max_labelled).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    return Logistic(x, got["__qg_y"].to_numpy(float))


def _logit_column(df: DataFrame, model: Logistic, text: str):
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.logit(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)))

    return logit(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _site(column: str):
    c = F.col(f"`{column}`").cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c))


def _strength(rates: DataFrame, good: str, count: str, mean, floor: float = 1.0, most: float = 1e4):
    """Beta prior strength by moments: rates (``good`` of ``count``) around their prior means ``mean``."""
    n = F.col(count)
    sums = rates.where(n > 0).agg(
        F.sum(n * F.pow(F.col(good) / n - mean, 2)).alias("spread"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(n * mean * (1 - mean)).alias("weight"),
    )
    got = sums.first()
    if not got["weight"]:
        return most
    share = ((got["spread"] or 0) - (got["noise"] or 0)) / got["weight"]
    return float(min(most, max(floor, 1 / share - 1))) if share > 0 else most


def _few(df: DataFrame, most: int) -> DataFrame:
    """A written table, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def with_evidence(df: DataFrame, labels: DataFrame, key: str, text: str, host: str, path: str, model: Logistic, label: str = "quality", max_broadcast: int = 200_000) -> DataFrame:
    """``df`` with __qg_host, __qg_path, __qg_logit and __qg_e, the evidence that it is good: its label, else the classifier's."""
    known, _ = materialize(_labels(labels, key, label), "labels")
    scored = df.withColumns({"__qg_host": _site(host), "__qg_path": _site(path), "__qg_logit": _logit_column(df, model, text)})
    joined = scored.join(_few(known, max_broadcast), scored[key] == F.col("__qg_id"), "left")
    return joined.withColumn("__qg_e", F.coalesce("__qg_y", 1 / (1 + F.exp(-F.col("__qg_logit"))))).drop("__qg_id", "__qg_y")


def judge(scored: DataFrame, rate: float, threshold: float = 0.5, max_broadcast: int = 200_000) -> DataFrame:
    """``scored`` (__qg_host, __qg_path, __qg_logit, __qg_e) with priors, probability and verdict, named likewise."""
    paths, _ = materialize(scored.groupBy("__qg_host", "__qg_path").agg(F.sum("__qg_e").alias("__qg_k"), F.count(F.lit(1)).cast("double").alias("__qg_n")), "paths")
    hosts = paths.groupBy("__qg_host").agg(F.sum("__qg_k").alias("__qg_hk"), F.sum("__qg_n").alias("__qg_hn"))
    total = paths.agg(F.sum("__qg_k").alias("k"), F.sum("__qg_n").alias("n")).first()
    k, n = total["k"] or 0.0, total["n"] or 0.0
    overall = (k + 0.5) / (n + 1)
    by_host = _strength(hosts, "__qg_hk", "__qg_hn", F.lit(overall))
    sites, _ = materialize(paths.join(hosts, "__qg_host"), "sites")
    by_path = _strength(sites, "__qg_k", "__qg_n", (F.col("__qg_hk") + by_host * overall) / (F.col("__qg_hn") + by_host))
    # each level without the document itself
    own = F.col("__qg_e")
    whole = (k + 0.5 - own) / F.lit(max(n, 1.0))
    at_host = (F.col("__qg_hk") - own + by_host * whole) / (F.col("__qg_hn") - 1 + by_host)
    at_path = (F.col("__qg_k") - own + by_path * F.col("__qg_host_prior")) / (F.col("__qg_n") - 1 + by_path)
    prior = F.least(F.greatest(F.col("__qg_path_prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("__qg_logit") - F.lit(float(np.log(rate / (1 - rate)))) + F.log(prior / (1 - prior))
    return (
        scored.join(_few(sites, max_broadcast), ["__qg_host", "__qg_path"]).withColumn("__qg_host_prior", at_host).withColumn("__qg_path_prior", at_path)
        .withColumn("__qg_probability", 1 / (1 + F.exp(-odds))).withColumn("__qg_keep", F.col("__qg_probability") >= threshold)
    )


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, **options) -> DataFrame:
    """``key``, host, path, classifier logit, both priors of the document, probability and keep."""
    model = fit(df, labels, key, text, **options)
    names = [key, "__qg_host", "__qg_path", "__qg_logit", "__qg_e"]
    scored, _ = materialize(with_evidence(df, labels, key, text, host, path, model).select(*names), "scored")
    plain = lambda c: F.when(F.col(c) == "-", F.lit(None).cast("string")).otherwise(F.substring(c, 2, 1 << 30)).alias(c[5:])
    return judge(scored, model.rate, threshold).select(
        key, plain("__qg_host"), plain("__qg_path"), F.col("__qg_logit").alias("logit"), F.col("__qg_host_prior").alias("host_prior"), F.col("__qg_path_prior").alias("path_prior"),
        F.col("__qg_probability").alias("probability"), F.col("__qg_keep").alias("keep"),
    )


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, max_broadcast: int = 500_000, **options) -> DataFrame:
    """The documents the classifier keeps, with their columns. Scores are written without the texts, under the
    key and a hash of the site and text, so rows alike in these are judged alike; those rejected are
    broadcast if there are few enough, and no text is shuffled then."""
    model = fit(df, labels, key, text, **options)
    told = F.xxhash64(_site(host), _site(path), F.col(f"`{text}`"))
    names = [F.col(f"`{key}`").alias("__qg_key"), "__qg_hash", "__qg_host", "__qg_path", "__qg_logit", "__qg_e"]
    scored, _ = materialize(with_evidence(df.withColumn("__qg_hash", told), labels, key, text, host, path, model).select(*names), "scored")
    bad, _ = materialize(judge(scored, model.rate, threshold).where("NOT __qg_keep").select("__qg_key", F.col("__qg_hash").alias("__qg_bad")).distinct(), "rejected")
    bad = _few(bad, max_broadcast)
    kept = df.withColumn("__qg_hash", told).join(bad, df[key].eqNullSafe(F.col("__qg_key")) & (F.col("__qg_hash") == F.col("__qg_bad")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def op7_quality(spark, sf_dir) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
