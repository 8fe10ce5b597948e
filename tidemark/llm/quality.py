"""Document quality by evidence of the text and hierarchical empirical Bayes over its site.

Evidence: two logistic models (junk, toxic) on style measures and on the weight of telling words, both
fitted on a bounded labelled sample (``SAMPLE`` rows in hash order; one half finds the words, the other
half fits). It is a log likelihood ratio: the fitted log odds less those of the sample.

Sites: the mean posterior of every host and of every path below it, over all documents, shrunk to the
host's and the corpus's. How strongly follows from the data: the strength is that of the beta prior
whose variance matches the spread between sites that sampling noise leaves over (method of moments).
A document is left out of the sums of its own site.
Final log odds are those of the path's shrunk mean plus the evidence.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import slices, whole_text
from tidemark.session import written

SAMPLE, WORDS, SEEN, TELLING = 16_000, 512, 3, 12.0
BATCH_BYTES = 4 << 20
RIDGE, CLIP, KEEP_AT = 1e-2, 12.0, 0.5
SYMBOLS = "!#$%&*|@~^_=+<>{}[]\\/"


def words_of(text: str) -> set[str]:
    return {word.strip(string.punctuation).lower() for word in set(text.split())}


def measures(text: str, telling: dict[str, float]) -> list[float]:
    """Style of a text, and the weight of the telling words it holds."""
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    weights = [telling[word] for word in {w.strip(string.punctuation).lower() for w in distinct} if word in telling]
    return [
        1.0,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, SYMBOLS)) / max(1, len(text)) * 10,
        len(distinct) / n,
        len(text) / n / 10,
        np.log1p(len(words)) / 10,
        text.count("\n") / n,
        min(3.0, sum(weights) / 5),
        float(bool(weights)),
    ]


@dataclass
class Model:
    telling: dict[str, float]
    junk: np.ndarray
    toxic: np.ndarray
    base: float  # log odds of a good document in the sample

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows = expand(np.array([measures(text or "", self.telling) for text in texts]))
        good = sigmoid(-(rows @ self.junk)) * sigmoid(-(rows @ self.toxic))
        return np.clip(np.log(good + 1e-9) - np.log(1 - good + 1e-9) - self.base, -CLIP, CLIP)


def expand(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.square(rows[:, 1:7])])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(rows: np.ndarray, truth: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = sigmoid(rows @ weights)
        gradient = rows.T @ (p - truth) + RIDGE * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The evidence model. Without any labelled document it gives no evidence either way.

    ``labels(doc_id, quality, toxic)``: rows with a null are left out; of repeated ones the worst counts.
    """
    known = (labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    some = written(known.orderBy(F.xxhash64("doc_id")).limit(sample), "quality-labels")
    rows = written(docs.select("doc_id", whole_text().alias("text")).join(some, "doc_id").select(
        "text", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0).alias("first"),
        (F.col("quality") == 0).alias("junk"), (F.col("toxic") == 1).alias("toxic")).dropDuplicates(["text"]), "quality-sample")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [list(words_of(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("toxic")], ["words", "toxic"])

    half = rows.where("first")
    totals = half.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("bad")).first()
    n, bad = float(totals["n"]), float(totals["bad"])
    counted = (half.select("text", "toxic").mapInArrow(told, "words array<string>, toxic boolean")
               .select(F.explode("words").alias("word"), "toxic").groupBy("word")
               .agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.count("*").alias("c")).where(F.col("a") >= SEEN))
    weight = (F.log((F.col("a") + 0.1) / (bad + 0.2)) - F.log((F.col("c") - F.col("a") + 0.1) / (n - bad + 0.2)))
    # what the word tells: its toxic share against the sample's, times its count
    tells = 2 * F.col("a") * F.log(F.col("a") * n / (F.col("c") * F.greatest(F.lit(bad), F.lit(1.0))))
    top = (counted.withColumn("weight", weight).withColumn("tells", tells).where((F.col("weight") > 1.5) & (F.col("tells") > TELLING))
           .orderBy(F.col("tells").desc(), "word").limit(WORDS).collect())
    telling = {row["word"]: min(5.0, row["weight"]) for row in top}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [measures(text, telling) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("junk"), batch.column("toxic")],
                                             ["row", "junk", "toxic"])

    other = rows.where("not first").select("text", "junk", "toxic").mapInArrow(
        measured, "row array<double>, junk boolean, toxic boolean").toPandas()  # at most ``sample`` short rows
    if not len(other):
        nothing = np.zeros(expand(np.zeros((1, 9))).shape[1])
        return Model({}, nothing, nothing, float(np.log(0.25 / 0.75)))
    table = expand(np.stack(list(other["row"])))
    good = float(((~other["junk"]) & (~other["toxic"])).mean())
    return Model(telling, fit_logistic(table, other["junk"].to_numpy(float)), fit_logistic(table, other["toxic"].to_numpy(float)),
                 float(np.log(np.clip(good, 0.01, 0.99) / (1 - np.clip(good, 0.01, 0.99)))))


def with_evidence(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """``_row`` (the row of ``docs(text, ...)``; its text only with ``whole``) and ``_evidence``.

    A row goes through Python once, as one struct, so that no column can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [name for name in docs.columns if whole or name != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_row", BATCH_BYTES, "text") if whole else slices(batches, "_text", BATCH_BYTES):
            texts = pa.compute.struct_field(batch.column("_row"), "text") if whole else batch.column("_text")
            evidence = pa.array(shared.value.evidence(texts.to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), evidence], ["_row", "_evidence"])

    rows = docs.select(F.struct(*kept).alias("_row"), *([] if whole else [F.col("text").alias("_text")]))
    return rows.mapInArrow(scored, T.StructType([rows.schema["_row"], T.StructField("_evidence", T.DoubleType())]))


def strength(mean: Column, between: Column) -> Column:
    """Pseudo-documents of the beta prior with this mean and variance."""
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def probability_of(evidence: Column, base: float) -> Column:
    return 1 / (1 + F.exp(-(evidence + F.lit(base))))


def site_sums(evidence: DataFrame, host: Column, path: Column, base: float) -> tuple[DataFrame, float, float, float]:
    """``_host, _path, n, s, hn, hs`` per path of ``evidence(_evidence, ...)``, and what all sites share:
    the mean posterior, the strength of its prior, and the variance between a host's paths.

    Counts are combined before they are exchanged, so a host with a third of the rows is no hot key.
    """
    p = probability_of(F.col("_evidence"), base)
    paths = written(evidence.groupBy(host.alias("_host"), path.alias("_path")).agg(
        F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    noise = F.greatest(F.lit(0.0), F.col("hq") / F.col("hn") - F.pow(F.col("hs") / F.col("hn"), 2)) / F.col("hn")
    whole = hosts.agg(
        (F.sum("hs") / F.sum("hn")).alias("mean"), F.count("*").alias("hosts"),
        (F.sum(F.col("hs") * F.col("hs") / F.col("hn")) / F.sum("hn") - F.pow(F.sum("hs") / F.sum("hn"), 2)).alias("spread"),
        (F.sum(noise * F.col("hn")) / F.sum("hn")).alias("noise")).first()
    mean = min(0.999, max(0.001, whole["mean"] if whole["mean"] is not None else 0.5))
    between = max(0.0, (whole["spread"] or 0.0) - (whole["noise"] or 0.0))
    k = float(min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1)))
    hosts = hosts.select(F.col("_host").alias("_h"), "hn", "hs")
    joined = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"])).drop("_h")
    shrunk = (F.col("hs") + k * F.lit(mean)) / (F.col("hn") + k)
    inner = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)) / F.col("n")
    spread = joined.agg((F.sum(F.col("n") * (F.pow(F.col("s") / F.col("n") - shrunk, 2) - inner)) / F.sum("n")).alias("v")).first()["v"]
    sites = written(joined.select("_host", "_path", "n", "s", "hn", "hs"), "quality-sites")
    return sites, mean, k, float(max(0.0, spread or 0.0))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE,
             keep_at: float = KEEP_AT, whole: bool = True) -> DataFrame:
    """``docs`` with evidence, host_posterior, path_posterior, probability and keep.

    A path is a pair of host and path value; nulls are values of their own. Null text counts as empty.
    Repeated rows are documents each. A document's site is judged by its other documents: its own posterior is
    taken out of the sums of its path and host, so that its evidence counts once. Without labels the
    probability is the same for all documents of a site. An empty table gives an empty one. Columns of these names are replaced;
    others pass through, but for ``text`` with ``whole=False``. Every text is scored once.
    """
    added = ["evidence", "host_posterior", "path_posterior", "probability", "keep"]
    model = fit(docs, labels, sample)
    scored = written(with_evidence(docs, model, whole), "quality-evidence")
    sites, mean, k, spread = site_sums(scored, F.col("_row").getField(host), F.col("_row").getField(path), model.base)
    joined = scored.join(sites, F.col("_row").getField(host).eqNullSafe(sites["_host"])
                         & F.col("_row").getField(path).eqNullSafe(sites["_path"]))
    own = probability_of(F.col("_evidence"), model.base)
    of_host = (F.col("hs") - own + k * F.lit(mean)) / (F.col("hn") - 1 + k)
    k_path = strength(F.col("host_posterior"), F.lit(spread))
    of_path = (F.col("s") - own + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    inside = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("path_posterior")))
    judged = (joined.withColumn("host_posterior", of_host).withColumn("path_posterior", of_path)
              .withColumn("probability", 1 / (1 + F.exp(-(F.col("_evidence") + logit(inside)))))
              .withColumn("keep", F.col("probability") >= keep_at))
    others = [name for name in docs.columns if name not in added and (whole or name != "text")]
    return judged.select(*[F.col("_row").getField(name).alias(name) for name in others], F.col("_evidence").alias("evidence"), *added[1:])
