"""Quality classifier: document evidence combined with empirical-Bayes site posteriors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import cut
from latticework.llm.url_reputation import strength

#: Bound of the labelled rows that the document classifier is fitted on.
TRAIN_ROWS = 8000
KEEP = 0.5
FEATURES = ("upper", "digit", "mark", "odd", "bar", "space", "word", "varied", "repeated", "lines")
_MARKS = np.frombuffer(b".,;:!?'\"-()", np.uint8)
_ODD = np.frombuffer(b"#$%&*+/<=>@[]^_`{}~\\", np.uint8)


def features(text: str | None) -> list[float]:
    """Of the whole text: shares of upper case, digits, marks, odd signs, bars and spaces;
    mean word length; how varied its words are; repeated words; repeated lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n, of = len(data), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = max(1, int(of[65:91].sum() + of[97:123].sum()))
    return [
        of[65:91].sum() / letters, of[48:58].sum() / n, of[_MARKS].sum() / n, of[_ODD].sum() / n, of[124] / n, (of[32] + of[10]) / n,
        min(1.0, sum(map(len, words)) / len(words) / 20), np.log1p(len(set(words))) / np.log1p(len(words)), again / len(words), len(set(lines)) / len(lines),
    ]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent on standardised values and their squares;
    weights for widened() values, and the bias."""
    x = widened(x)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= rate * (z.T @ gap / len(y) + decay * w)
        b -= rate * gap.mean()
    w = w / spread
    return w, b - float(mean @ w)


def widened(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, x * x, np.sqrt(np.maximum(x, 0))), axis=1)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def site_posteriors(outcomes: DataFrame, host_prior: float | None = None, path_prior: float | None = None) -> tuple[float, DataFrame, DataFrame]:
    """(global rate, (host, host_rate), (host, path, path_rate)) from (host, path, good).

    A host's rate of good documents is shrunk to the global rate, a path's to its host's, each
    by a beta-binomial prior; its strength, in labelled documents, is fitted by moments at its
    level, if not given. Sparse sites stay near the level above. Only counts by site are shuffled, so a host of a third of all rows costs a row for each task."""
    paths = cut(outcomes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = (good + 1) / (n + 2) if n else 0.5
    fitted = lambda sites: strength(sites.withColumn("bad", F.col("n") - F.col("good")))[1]
    host_prior, path_prior = host_prior or fitted(hosts), path_prior or fitted(paths)
    by_host = hosts.select("host", ((F.col("good") + host_prior * rate) / (F.col("n") + host_prior)).alias("host_rate"))
    by_path = paths.join(by_host, "host").select("host", "path", ((F.col("good") + F.col("host_rate") * path_prior) / (F.col("n") + path_prior)).alias("path_rate"))
    return rate, by_host, by_path


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: (doc_id, text_score, host_rate, path_rate, quality, kept).

    labels (doc_id, quality): of several labels of one document the worst counts; null ones
    don't. text_score is a logistic regression on features of the whole text, fitted on at
    most `train_rows` labelled rows, those whose ids hash lowest. quality adds to its log-odds
    those of the document's path (or, without labels there, its host) relative to the global
    rate. Null hosts and paths are sites of their own. Null or empty texts score 0 and aren't
    kept. Without any label text_score is 0.5. Repeated rows and null ids are returned as they
    are; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(parts):
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "host": part.host, "path": part.path, "x": [features(x) if isinstance(x, str) else [0.0] * len(FEATURES) for x in part.text]})

    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), site(host_col).alias("host"), site(path_col).alias("path"))
    measured = cut(rows.mapInPandas(measure, "doc_id string, host string, path string, x array<double>"))
    told = labels.where("quality is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("quality").cast("long").alias("good"))
    known = cut(measured.join(told, "doc_id"))
    rate, by_host, by_path = site_posteriors(known.select("host", "path", "good"))
    # Hashes under a share somewhat above the bound's: else each task would send the driver as many rows.
    share = min(1.0, (1.2 * train_rows + 200) / max(1, known.count()))
    few = known.where("exists(x, v -> v <> 0)").where(F.xxhash64("doc_id") / 2.0**64 + 0.5 <= share)
    sample = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("doc_id", "x", "good").toPandas().sort_values("doc_id", kind="stable")
    w, b = fit(np.array(sample.x.tolist()), sample.good.to_numpy(float)) if len(sample) else (np.zeros(3 * len(FEATURES)), 0.0)
    k = len(FEATURES)
    evidence = F.lit(float(b))
    for i in range(k):
        v = F.col("x")[i]
        evidence = evidence + v * float(w[i]) + v * v * float(w[k + i]) + F.sqrt(F.greatest(v, F.lit(0.0))) * float(w[2 * k + i])
    blank = ~F.exists("x", lambda v: v != 0)
    scored = measured.select("doc_id", "host", "path", blank.alias("blank"), (1 / (1 + F.exp(-evidence))).alias("text_score"))
    joined = scored.join(by_host, "host", "left").join(by_path, ["host", "path"], "left")
    host_rate = F.coalesce("host_rate", F.lit(rate))
    path_rate = F.coalesce("path_rate", host_rate)
    odds = logit(F.col("text_score")) + logit(path_rate) - logit(F.lit(rate))
    quality = F.when(F.col("blank"), 0.0).otherwise(1 / (1 + F.exp(-odds)))
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), F.when(F.col("blank"), 0.0).otherwise(F.col("text_score")).alias("text_score"), host_rate.alias("host_rate"), path_rate.alias("path_rate"), quality.alias("quality"), (quality >= KEEP).alias("kept"))
