"""Toxicity by a classifier chain.

Categories come one after another.  Each has a linear model over hashed word,
prefix and suffix features, the text's length and the log-odds of all earlier
categories; for training those are out-of-fold, so a later model learns from odds
as good as it will meet.  A feature's value is the number of distinct words that
have it over the square root of all distinct words: in a long text some have any
feature by chance, so it is their density that tells.  Training uses a bounded sample of labelled documents on the driver;
scoring reads every document whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import frugal, per_worker, texts
from labelgrid.plans.materialize import discard, materialize

#: Labelled documents used for training at most: those of the smallest id hash.
SAMPLE = 6000
FOLDS = 5
BUCKETS = 1 << 18
MASK = BUCKETS - 1
#: A feature needs this many training documents.
MIN_DOCS = 3
#: Features a model keeps.
KEPT = 512
THRESHOLD = 0.5
#: Words whose features a worker remembers.
KNOWN = 800_000
ROUNDS, PENALTY = 200, 1e-5
#: Factor of feature values, for the step size.
SCALE = 5.0

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    """Buckets of a word, of its first 3 to 8 bytes and its last 3."""
    raw = word.encode()
    found = {zlib.crc32(raw, 1) & MASK, zlib.crc32(raw[-3:], 2) & MASK}
    for n in range(3, min(len(raw), 8) + 1):
        found.add(zlib.crc32(raw[:n], n) & MASK)
    return found


def values(counts, n_words):
    """Feature values of counts among so many distinct words."""
    return SCALE * counts / np.sqrt(np.maximum(n_words, 1))


def length(n_words):
    return np.log(np.maximum(n_words, 1))


@dataclass
class Chain:
    """``features``: buckets that any model uses, ascending; ``weights``: those x categories; ``links``: weights of length and earlier log-odds; ``bias``."""

    names: list[str]
    features: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray

    def odds(self, sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Log-odds of all categories, one after the other, from the weighted counts (documents x categories)."""
        dense = length(n_words)[:, None]
        for k in range(len(self.names)):
            out = values(sums[:, k], n_words) + dense @ self.links[k, : k + 1] + self.bias[k]
            dense = np.column_stack([dense, np.clip(out, -30, 30)])
        return dense[:, 1:]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def informative(features: np.ndarray, seen: np.ndarray, both: np.ndarray, n: float, pos: float) -> np.ndarray:
    """The KEPT features whose presence differs most between the classes (chi-square).

    ``seen``, ``both``: documents, and positive ones, that have each of ``features``; ``n``, ``pos``: all of them.
    """
    spread = seen * (n - seen) * max(pos * (n - pos), 1e-9)
    score = np.where(seen >= MIN_DOCS, (n * both - seen * pos) ** 2 / np.maximum(spread, 1e-9), -1)
    top = np.argsort(-score, kind="stable")[:KEPT]
    return np.sort(features[top[score[top] > 0]])


def fit_linear(x, dense, y):
    """L2 logistic regression of feature values (documents x features) and dense columns, by AdaGrad over all rows."""
    v, u = np.zeros(x.shape[1]), np.zeros(dense.shape[1] + 1)
    rate = y.mean() if len(y) else 0.0
    u[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    if not 0 < rate < 1:
        return v, u[:-1], u[-1]
    gv, gu = np.full(len(v), 1e-8), np.full(len(u), 1e-8)
    full = np.column_stack([dense / 10, np.ones(len(y))])
    for _ in range(ROUNDS):
        miss = sigmoid(np.einsum("ij,j->i", x, v.astype("f4")) + np.einsum("ij,j->i", full, u)) - y
        d = np.einsum("i,ij->j", miss.astype("f4"), x) / len(y) + PENALTY * v  # einsum: one thread, one order of sums
        e = np.einsum("i,ij->j", miss, full) / len(y)
        gv += d * d
        gu += e * e
        v -= 0.2 * d / np.sqrt(gv)
        u -= 0.1 * e / np.sqrt(gu)
    return v, u[:-1] / 10, u[-1]


def fit_chain(names: list[str], chosen: list[list[np.ndarray]], docs, feats, counts, n_words, labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit all categories; ``labels`` documents x categories, NaN where unknown.

    ``chosen``: for each category the features of its models, without each fold and at last of all; ``docs, feats, counts``
    hold no others.
    """
    n, vals = len(labels), values(counts, n_words[docs])
    features = np.unique(np.concatenate([np.zeros(0, "i8"), *(c for cs in chosen for c in cs)]))
    weights, links, bias = np.zeros((len(features), len(names))), np.zeros((len(names), len(names))), np.zeros(len(names))
    earlier = length(n_words)[:, None]

    def fit(rows, mine, y, dense):
        """Weights of ``mine``, and the log-odds of all documents."""
        part = np.isin(feats, mine)
        x = np.zeros((n, len(mine)), "f4")  # at most SAMPLE x KEPT
        x[docs[part], np.searchsorted(mine, feats[part])] = vals[part]
        w, u, b = fit_linear(x[rows], dense[rows], y[rows])
        return w, u, b, np.einsum("ij,j->i", x, w) + dense @ u + b

    for k in range(len(names)):
        y = labels[:, k]
        known = ~np.isnan(y)
        odds = np.zeros(n)
        for f in range(FOLDS):
            margin = fit(known & (folds != f), chosen[k][f], y, earlier)[3]
            odds[folds == f] = margin[folds == f]
        w, u, b, _ = fit(known, chosen[k][FOLDS], y, earlier)
        weights[np.searchsorted(features, chosen[k][FOLDS]), k], links[k, : k + 1], bias[k] = w, u, b
        earlier = np.column_stack([earlier, np.clip(odds, -30, 30)])
    return Chain(names, features, weights, links, bias)


def _choose(rows: DataFrame, names: list[str], totals: pa.Table) -> list[list[np.ndarray]]:
    """For each category its models' features: without each fold, then of all.

    Documents are counted by feature on the executors; at most BUCKETS rows of counts come to the driver.
    """
    flat = rows.select("fold", *names, F.explode("f").alias("feature"))
    here = lambda name, f: (F.col("fold") == f) & F.col(name).isNotNull()
    sums = []
    for k, name in enumerate(names):
        for f in range(FOLDS):
            sums += [F.sum(F.when(here(name, f), 1).otherwise(0)).cast("int").alias(f"n{k}_{f}"), F.sum(F.when(here(name, f), F.col(name).cast("int")).otherwise(0)).cast("int").alias(f"y{k}_{f}")]
    got = flat.groupBy("feature").agg(*sums).toArrow().sort_by("feature")
    features, fold, out = got.column("feature").to_numpy(), totals.column("fold").to_numpy(), []
    for k, name in enumerate(names):
        y = totals.column(name).to_numpy()
        models = []
        for skip in range(FOLDS + 1):
            rest = ~np.isnan(y) & (fold != skip)
            seen, both = (sum(got.column(f"{c}{k}_{f}").to_numpy().astype("f8") for f in range(FOLDS) if f != skip) for c in "ny")
            models.append(informative(features, seen, both, float(rest.sum()), float(y[rest].sum())))
        out.append(models)
    return out


def train(documents: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit a chain from ``labels`` (id and one 0/1 column per name; NULL: unknown).

    At most ``sample`` labelled documents, those of the smallest hash of the id, take part.  Of a repeated id the least
    text and the greatest labels count; a NULL id has no label.  Features are counted and chosen on the executors; the
    driver gets the chosen ones only.  With no usable label a category's probability is its prior.
    """
    slots = [f"y{k}" for k in range(len(names))]
    picked = labels.select(F.col(id_col).alias("id"), *[F.col(n).cast("double").alias(s) for n, s in zip(names, slots)]).where(F.col("id").isNotNull())
    picked = picked.orderBy(F.xxhash64("id"), "id", *slots).limit(sample)
    joined = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    once = joined.groupBy("id").agg(F.min("text").alias("text"), *[F.max(s).alias(s) for s in slots])

    def count(batches):
        for batch in batches:
            words = [set(WORD.findall(t.lower())) for t in texts(batch)]
            found = [sorted(Counter(b for w in ws for b in word_features(w)).items()) for ws in words]
            lists = [pa.array([[x[k] for x in row] for row in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.record_batch([batch.column("id"), *[batch.column(s) for s in slots], *lists, pa.array([len(ws) for ws in words], pa.int32())], names=["id", *slots, "f", "c", "n_words"])

    def keep(batches):
        for batch in batches:
            lists = batch.column("f"), batch.column("c")
            feats, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            doc = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy())
            mine = np.isin(feats, wanted)
            stops = np.concatenate([[0], np.cumsum(np.bincount(doc[mine], minlength=batch.num_rows))]).astype("i4")
            cut = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x[mine])) for x in (feats, counts)]
            yield pa.record_batch([batch.column("id"), *cut], names=["id", "f", "c"])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{s} double" for s in slots) + ", f array<int>, c array<int>, n_words int"
    fold = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(FOLDS)).cast("int")
    rows = materialize(once.select("id", *slots, "text").mapInArrow(count, schema).withColumn("fold", fold), "toxicity-sample")
    totals = rows.select("id", *slots, "n_words", "fold").toArrow().sort_by("id")
    chosen = _choose(rows, slots, totals)
    wanted = np.unique(np.concatenate([c for cs in chosen for c in cs]))
    got = rows.select("id", "f", "c").mapInArrow(keep, f"id {kind}, f array<int>, c array<int>").toArrow().sort_by("id")
    discard(rows)
    feats, counts = (got.column(c).combine_chunks() for c in "fc")
    docs = np.repeat(np.arange(got.num_rows, dtype="i4"), feats.value_lengths().to_numpy(zero_copy_only=False)) if got.num_rows else np.zeros(0, "i4")
    flat, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (feats, counts))
    y = np.column_stack([totals.column(s).to_numpy().astype("f8") for s in slots])
    return fit_chain(names, chosen, docs, flat, counts, totals.column("n_words").to_numpy().astype("i8"), y, totals.column("fold").to_numpy())


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``'s columns (but of those names) and ``p_<name>`` double for each category; a NULL or empty text scores its prior.

    Repeated rows and NULL ids are scored like any others; an empty frame gives no rows.
    """
    names = [f"p_{n}" for n in chain.names]
    df = df.drop(*names)
    text_at = df.columns.index(text_col)
    token = f"toxicity {zlib.crc32(chain.weights.tobytes())} {zlib.crc32(chain.features.tobytes())} {chain.bias.tolist()}"

    def predict(batches):
        # Words met so far, and the summed weights of those that have any.
        met, telling = per_worker(token, lambda: (set(), {}))
        width, live = len(chain.names), chain.weights.any(axis=1)
        columns = dict(zip(chain.features[live].tolist(), chain.weights[live].tolist()))
        used = set(columns)
        for batch in batches:
            sums, n_words = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows)
            for k, t in enumerate(batch.column(text_at).to_pylist()):
                words = set(WORD.findall((t or "").lower()))
                if len(met) > KNOWN:
                    met.clear()
                    telling.clear()
                for w in words - met:
                    got = [columns[b] for b in sorted(word_features(w) & used)]
                    if got:
                        telling[w] = tuple(math.fsum(x) for x in zip(*got))
                met |= words
                n_words[k] = len(words)
                found = [telling[w] for w in words if w in telling]
                if found:
                    sums[k] = [math.fsum(x) for x in zip(*found)]  # exact, so in any order of the words
            p = sigmoid(chain.odds(sums, n_words))
            yield pa.record_batch([*batch.columns, *[pa.array(p[:, k]) for k in range(width)]], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in names)
    return df.mapInArrow(frugal("toxicity", predict), fields)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The chain's columns: ``junk`` (low quality), then ``toxic``."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


CATEGORIES = ["junk", "toxic"]
