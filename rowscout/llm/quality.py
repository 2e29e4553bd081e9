"""Quality by hierarchical empirical Bayes over document evidence, host and path.

Document evidence is a linear classifier's log odds, from words and the shape of the text. It is fitted on the driver
from at most `most_labels` labelled rows; the evidence of every document is then summed by site: the host (source) and
the path on it (source and language). A host's rate is a Beta posterior around the global rate, a path's around its
host's; the strength of either prior is estimated from the spread between hosts and between paths, so sparse sites are
shrunk to what is above them. A document's posterior adds the site's shift of log odds to its own evidence.

Two rates are estimated this way, good and toxic. A document stays if it is good with probability good_at or more and
toxic with less than toxic_at; the latter is low, since toxic documents are few and keeping one costs more than losing
one that is not.

Cases: a null text counts as empty. A null or missing source or language is a site like any other. Documents without an
id are judged too. Repeated labels are used as they are; labels without a document, or null, are not used. Without
usable labels of both kinds, a rate is taken as the labels' mean (0.5 if there is none; for toxicity 0), for every
document alike. Empty in, empty out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from .frames import bound_batches, by_size, durable, free_memory, map_batches, pick, position

SHAPES = 10
MOST_BROADCAST = 50_000
MOST_KEYS = 100_000  # rows of two numbers
_WORD = re.compile(r"[^\W\d_]+")


def shape(text: str) -> list[float]:
    """What a text looks like: shares of upper case, marks, digits and lines, repetition, and length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    marked = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    return [
        1.0,
        upper / w,
        marked / n * 10,
        counts[48:58].sum() / n * 10,
        same / w,
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        (counts[124] + counts[33] + counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / n * 10,
        math.log1p(len(words)) / 8,
        len(raw) / w / 10,
    ]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Linear:
    """Log odds from the shape and from the words that tell the two kinds apart."""

    def __init__(self, shape_weights: np.ndarray, word_weights: dict[str, float]):
        self.shape_weights, self.word_weights = shape_weights, word_weights

    def evidence(self, form: list[float], words: set[str]) -> float:
        got = self.word_weights
        return float(np.dot(self.shape_weights, form)) + sum(got[w] for w in words if w in got)


def fit_linear(forms: np.ndarray, words: list[set[str]], y: np.ndarray, most_words: int = 4096, ridge: float = 1e-3) -> Linear:
    """Logistic regression. Of the words, those in three documents or more whose counts in the two kinds differ beyond
    chance (chi-squared 12 or more) take part, the most telling first."""
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)
        return Linear(np.r_[math.log(p / (1 - p)), np.zeros(SHAPES - 1)], {})
    ones, all_ = Counter(), Counter()
    for w, t in zip(words, y, strict=True):
        all_.update(w)
        if t:
            ones.update(w)
    n, share = len(y), y.mean()
    told = []
    for w, c in all_.items():
        if c >= 3:
            chi = (ones[w] - c * share) ** 2 / (c * share * (1 - share)) * n / max(1, n - c)
            if chi >= 12:
                told.append((-chi, w))
    names = [w for _, w in sorted(told)[:most_words]]
    index = {w: i for i, w in enumerate(names)}
    rows, cols = [], []
    for r, w in enumerate(words):
        hit = [index[x] for x in w if x in index]
        rows += [r] * len(hit)
        cols += hit
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    a, b = np.zeros(SHAPES), np.zeros(len(names))
    ga, gb = np.full(SHAPES, 1e-8), np.full(len(names), 1e-8)
    for _ in range(400):  # full-batch AdaGrad
        z = forms @ a + np.bincount(rows, b[cols], n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        da = forms.T @ d + ridge * np.r_[0, a[1:]]
        db = np.bincount(cols, d[rows], len(names)) + ridge * 0.1 * b
        ga += da**2
        gb += db**2
        a -= 0.5 * da / np.sqrt(ga)
        b -= 0.5 * db / np.sqrt(gb)
    return Linear(a, dict(zip(names, b.tolist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Linear]:
    """Classifiers of `quality` and `toxic` from at most most_labels labelled documents, chosen by a hash of their id."""
    told = pick(labels, **{id_col: "long", "quality": "double", "toxic": "double"})
    told = told.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), "quality", "toxic").limit(most_labels)
    told = told.withColumnRenamed(id_col, "_label_id")
    texts = pick(docs, **{id_col: "long", text_col: "string"})
    got = texts.join(F.broadcast(told), F.col(id_col) == F.col("_label_id"))  # most_labels rows of three numbers
    got = got.select(F.coalesce(text_col, F.lit("")).alias("text"), "quality", "toxic")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        forms = pa.array([shape(t) for t in texts], pa.list_(pa.float64()))
        words = pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([forms, words, batch.column(1), batch.column(2)], ["form", "words", "quality", "toxic"])

    rows = map_batches(got, features, "form array<double>, words array<string>, quality double, toxic double").toArrow()
    forms = np.array(rows.column("form").to_pylist(), float).reshape(-1, SHAPES)
    words = [set(w) for w in rows.column("words").to_pylist()]
    out = {}
    for target in ("quality", "toxic"):
        y = np.array([np.nan if v is None else v for v in rows.column(target).to_pylist()], float)
        known = np.flatnonzero(~np.isnan(y))
        out[target] = fit_linear(forms[known], [words[i] for i in known], y[known] >= 0.5)
        if target == "toxic" and not len(known):
            out[target] = Linear(np.r_[-30.0, np.zeros(SHAPES - 1)], {})
    return out


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_shifts(evidence: DataFrame) -> DataFrame:
    """host, path, shift_quality, shift_toxic, and the posteriors they come from, for every site.

    evidence: host, path, z_quality, z_toxic of each document. Only sums by path are shuffled, combined on the map side,
    so a host of very many documents is one row from each task. The priors are one row.
    """
    sums = [F.count("*").alias("n")]
    sums += [F.sum(_logistic(F.col(f"z_{t}"))).alias(f"s_{t}") for t in ("quality", "toxic")]
    paths = durable(evidence.groupBy("host", "path").agg(*sums))  # a row for each path
    hosts = paths.groupBy(F.col("host").alias("of")).agg(F.sum("n").alias("hn"), *(F.sum(f"s_{t}").alias(f"h_{t}") for t in ("quality", "toxic")))
    whole = hosts.agg(F.sum("hn").alias("gn"), *(F.sum(f"h_{t}").alias(f"g_{t}") for t in ("quality", "toxic")))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of").crossJoin(F.broadcast(whole))
    for t in ("quality", "toxic"):
        rate = lambda s, n: (F.col(s) + 0.5) / (F.col(n) + 1)
        sites = sites.withColumn(f"m_{t}", rate(f"g_{t}", "gn")).withColumn(f"hr_{t}", F.col(f"h_{t}") / F.col("hn"))
    # between-site variance by moments: spread of the rates less what sampling alone gives; kappa = m (1 - m) / var - 1
    spread = []
    for t in ("quality", "toxic"):
        m = F.col(f"m_{t}")
        w = F.col("n")
        of_hosts = F.sum(w * (F.col(f"hr_{t}") - m) ** 2) / F.sum(w) - F.avg(m * (1 - m) / F.col("hn"))
        of_paths = F.sum(w * (F.col(f"s_{t}") / w - F.col(f"hr_{t}")) ** 2) / F.sum(w) - F.avg(m * (1 - m) / w)
        for name, var in (("host", of_hosts), ("path", of_paths)):
            v = F.greatest(var, F.lit(1e-6))
            spread.append(F.least(F.greatest(F.avg(m * (1 - m)) / v - 1, F.lit(4.0)), F.lit(1e5)).alias(f"k_{name}_{t}"))
    sites = sites.crossJoin(F.broadcast(sites.agg(*spread)))
    for t in ("quality", "toxic"):
        k, m = F.col(f"k_host_{t}"), F.col(f"m_{t}")
        sites = sites.withColumn(f"host_{t}", (k * m + F.col(f"h_{t}")) / (k + F.col("hn")))
        k = F.col(f"k_path_{t}")
        sites = sites.withColumn(f"path_{t}", (k * F.col(f"host_{t}") + F.col(f"s_{t}")) / (k + F.col("n")))
        sites = sites.withColumn(f"shift_{t}", _odds(F.col(f"path_{t}")) - _odds(m))
    kept = [f"{a}_{t}" for t in ("quality", "toxic") for a in ("shift", "host", "path")]
    return sites.select("host", "path", F.col("n").alias("site_docs"), *kept)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    most_labels: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    good_at: float = 0.5,
    toxic_at: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """docs under plain names (_c0, _c1, ...) with what tells a row (_id, and _key, a hash of text and site), and for each
    of them a row of _id, _key, p_quality, p_toxic, keep and its site's columns, without the text.

    The evidence of every text is computed once and kept as a narrow table, from which both the sums of sites and the
    verdicts come. It meets the table of sites, which is broadcast if it has at most MOST_BROADCAST rows and otherwise
    joined by key.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    text = F.coalesce(F.col(f"_c{position(names, text_col)}").cast("string"), F.lit(""))
    low = [x.lower() for x in names]
    site = [
        (F.col(f"_c{position(names, c)}").cast("string") if c.lower() in low else F.lit(None).cast("string"))
        for c in (host_col, path_col)
    ]
    plain = plain.withColumn("_id", F.col(f"_c{position(names, id_col)}").cast("long")).withColumn("_key", F.xxhash64(text, *site))
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most_labels, id_col, text_col))

    def run(batches):
        free_memory()  # what other stages have left in this worker
        kinds = pa.struct([("z_quality", pa.float64()), ("z_toxic", pa.float64())])
        quality, toxic = models.value["quality"], models.value["toxic"]
        for texts in batches:
            rows = []
            for lo, hi in by_size(texts, 2_000_000):
                for t in texts.slice(lo, hi - lo).to_pylist():
                    form, words = shape(t), words_of(t)
                    rows.append({"z_quality": quality.evidence(form, words), "z_toxic": toxic.evidence(form, words)})
            yield pa.array(rows, kinds)

    evidence = F.arrow_udf(run, "z_quality double, z_toxic double", ArrowUDFType.SCALAR_ITER)
    told = plain.select("_id", "_key", site[0].alias("_host"), site[1].alias("_path"), evidence(text).alias("_z"))
    told = durable(told.select("_id", "_key", "_host", "_path", "_z.*"), few=True)
    sites = durable(site_shifts(told.select(F.col("_host").alias("host"), F.col("_path").alias("path"), "z_quality", "z_toxic")))
    if sites.count() <= MOST_BROADCAST:  # rows of two names and a dozen numbers
        sites = F.broadcast(sites)
    joined = told.join(sites, F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path")), "left")
    good = _logistic(F.col("z_quality") + F.coalesce("shift_quality", F.lit(0.0)))
    toxic = _logistic(F.col("z_toxic") + F.coalesce("shift_toxic", F.lit(0.0)))
    posteriors = [f"{a}_{t}" for t in ("quality", "toxic") for a in ("host", "path")]
    keep = ((good >= good_at) & (toxic < toxic_at)).alias("keep")
    return plain, joined.select("_id", "_key", good.alias("p_quality"), toxic.alias("p_toxic"), keep, *posteriors)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, p_quality, p_toxic, keep, and the posteriors of host and path (host_quality, path_quality, ...)."""
    _, verdicts = judged(docs, labels, **options)
    return verdicts.drop("_key").withColumnRenamed("_id", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with docs' columns. Rows that go are found again by id, text and site: their keys are
    broadcast if there are few, so that no text is shuffled; otherwise the rows are joined by key."""
    plain, verdicts = judged(docs, labels, **options)
    gone = verdicts.where(~F.col("keep")).select(F.col("_id").alias("_gone"), F.col("_key").alias("_of")).distinct()
    gone = F.broadcast(gone) if gone.limit(MOST_KEYS + 1).count() <= MOST_KEYS else gone
    kept = plain.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_of")), "left_anti")
    return kept.drop("_id", "_key").toDF(*docs.columns)
