"""Operator 9, toxicity by weak supervision.

1. A bounded sample of the training rows that have labels (at most ``max_toxic`` and ``max_clean``, chosen by hash, one of
   each group of copies) is counted into words and beginnings of words (partial sums first). Those much commoner in toxic
   rows become lexicons, beside a fixed public one: ``stems``.
2. Voters: each lexicon votes toxic or abstains; patterns (several hits, dense hits, shouting) vote toxic, others (long
   texts without any hit, sober texts) vote clean.
3. A generative label model estimates each voter's accuracy from the votes alone by expectation maximisation, and from
   the votes' residuals the correlations of voters; correlated voters count less.
4. A logistic classifier is trained on the posterior labels; its features are the texts' hits and patterns.

The bounds cut the classes by different rates. In 3 and 4 each sampled row therefore counts as often as its class has
groups of copies for each one sampled, so that the share of toxic rows is that of the table at every size.

Scoring reads whole texts: words are looked up in a bounded table of each Python worker.

Defined results: a null or empty text has no words and gets the score of no hits; without labels of both kinds only the
fixed lexicon votes; a null doc_id has the crc32 of the empty string; repeated rows get equal results; labels that occur
more than once for a doc_id count as their largest; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import drop, written
from missiva.llm.langid import held_out, least_by_hash

#: Common English insults.
LEXICON = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown")
MAX_TOXIC = 6_000
MAX_CLEAN = 12_000
MIN_SUPPORT = 5
MIN_RATIO = 50.0
MAX_STEMS = 400
PREFIXES = (3, 4, 5, 6, 7)
LEXICONS = 8
TABLE_WORDS = 400_000
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
N_PATTERNS = 5


def mine_stems(sample: DataFrame, *, min_support: int = MIN_SUPPORT, min_ratio: float = MIN_RATIO, max_stems: int = MAX_STEMS) -> list[str]:
    """Word beginnings (``x*``) and words (``x``) much commoner in toxic rows than in clean ones; sample: (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())
        rows = [0, 0]
        for df in batches:
            for text, toxic in zip(df["text"], df["toxic"], strict=True):
                words = set(LETTERS.findall((text or "").lower()))
                counts[toxic].update({w for w in words if len(w) <= 24} | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n})
                rows[toxic] += 1
        features = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"feature": ["", *features], "clean": [rows[0], *map(counts[0].__getitem__, features)], "toxic": [rows[1], *map(counts[1].__getitem__, features)]})

    summed = sample.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = sample.agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    if not rows["c"] or not rows["t"]:
        return []
    ratio = ((F.col("toxic") + 0.5) / (rows["t"] + 1)) / ((F.col("clean") + 0.5) / (rows["c"] + 1))
    enough = max(min_support, rows["t"] // 100)
    found = (
        summed.filter((F.col("feature") != "") & (F.col("toxic") >= enough) & (ratio >= min_ratio))
        .orderBy(F.desc("toxic"), "feature")
        .limit(20 * max_stems)
        .collect()
    )
    support = {r["feature"]: r["toxic"] for r in found}
    stems: list[str] = []
    for feature in sorted(support, key=lambda f: (len(f.rstrip("*")), f)):  # shortest first
        bare = feature.rstrip("*")
        if any(bare.startswith(s.rstrip("*")) for s in stems if s.endswith("*")) or feature in stems:
            continue
        longer = [f for f in support if f.rstrip("*").startswith(bare) and support[f] >= 0.9 * support[feature]]
        stems.append(max(longer, key=lambda f: (len(f.rstrip("*")), f.endswith("*"), f)))
    return sorted(set(stems), key=lambda f: (-support[f], f))[:max_stems]


class Hits(dict):
    """Token -> numbers of the stems it holds, () for most; a bounded table."""

    def __init__(self, stems: list[str]):
        super().__init__()
        self.whole = {s: i for i, s in enumerate(stems) if not s.endswith("*")}
        self.starts = {s[:-1]: i for i, s in enumerate(stems) if s.endswith("*")}
        self.sizes = sorted({len(s) for s in self.starts})

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = []
        for word in LETTERS.findall(token.lower()):
            if word in self.whole:
                found.append(self.whole[word])
            found += [self.starts[word[:n]] for n in self.sizes if word[:n] in self.starts and len(word) >= n]
        if len(self) >= TABLE_WORDS:
            self.clear()
        self[token] = out = tuple(dict.fromkeys(found))
        return out


def features(text: str | None, hits: Hits, n_stems: int) -> np.ndarray:
    """log(1 + count) of each stem, then: any hit, log hits, hits a hundred words, shouting share, log words."""
    tokens = (text or "").split()
    x = np.zeros(n_stems + N_PATTERNS)
    total = 0
    for found in map(hits.__getitem__, tokens):
        if found:
            total += 1
            for i in found:
                x[i] += 1
    x[:n_stems] = np.log1p(x[:n_stems])
    shouted = sum(map(str.isupper, tokens)) / len(tokens) if tokens else 0.0
    x[n_stems:] = (total > 0, np.log1p(total), min(5.0, 100 * total / len(tokens)) if tokens else 0.0, shouted, np.log1p(len(tokens)))
    return x


def votes(x: np.ndarray, n_fixed: int, n_stems: int) -> np.ndarray:
    """The voters' votes (1 toxic, -1 clean, 0 none) on rows of features()."""
    lexicons = [x[:, :n_fixed].sum(axis=1)] + [x[:, n_fixed + k : n_stems : LEXICONS].sum(axis=1) for k in range(LEXICONS)]
    hit, logs, dense, shout, words = x[:, n_stems:].T
    columns = [np.where(s > 0, 1, 0) for s in lexicons]
    columns += [
        np.where(logs >= np.log(3), 1, 0),  # two hits or more
        np.where(dense >= 0.5, 1, 0),
        np.where((shout > 0.5) & (hit > 0), 1, 0),
        np.where((hit == 0) & (words > np.log(20)), -1, 0),
        np.where((hit == 0) & (shout < 0.5), -1, 0),
    ]
    return np.stack(columns, axis=1)


def label_model(v: np.ndarray, rounds: int = 30, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's accuracy and the voters' correlations, from the votes alone; each row counts ``times``."""
    n, m = v.shape
    times = np.ones(n) if times is None else times
    p = np.where(v.sum(axis=1) > 0, 0.9, 0.1)
    weight, correlation = np.ones(m), np.zeros((m, m))
    states = np.stack([v == s for s in (-1, 0, 1)], axis=2)  # row, voter, state
    for step in range(rounds):
        prior = np.clip(np.average(p, weights=times), 0.01, 0.5)
        theta = [(np.einsum("i,ijs->js", q, states) + 0.5) / (q.sum() + 1.5) for q in (times * (1 - p), times * p)]
        gain = np.log(theta[1]) - np.log(theta[0])
        if step == rounds // 2:
            # what two voters share beyond what the label explains
            signs = v - ((1 - p)[:, None] * (theta[0][:, 2] - theta[0][:, 0]) + p[:, None] * (theta[1][:, 2] - theta[1][:, 0]))
            off = signs - np.average(signs, axis=0, weights=times)
            covariance = (off * times[:, None]).T @ off / times.sum()
            spread = np.sqrt(np.diag(covariance))
            correlation = np.where(np.outer(spread, spread) > 1e-9, covariance / np.maximum(np.outer(spread, spread), 1e-9), 0)
            np.fill_diagonal(correlation, 1)
            weight = 1 / np.maximum(1, np.where(np.abs(correlation) > 0.3, np.abs(correlation), 0).sum(axis=1))
            # once more from the start: voters that repeat each other may have led the first half astray
            p = np.where((v * weight).sum(axis=1) > 0, 0.9, 0.1)
            continue
        logit = np.log(prior / (1 - prior)) + np.einsum("ijs,js,j->i", states, gain, weight)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    cast = (v != 0) * times[:, None]
    right = np.where(v > 0, p[:, None], 1 - p[:, None])
    accuracy = (right * cast).sum(axis=0) / np.maximum(cast.sum(axis=0), 1)
    return p, accuracy, correlation


def fit_logistic(x: np.ndarray, p: np.ndarray, l2: float = 0.1, rounds: int = 40, times: np.ndarray | None = None) -> np.ndarray:
    """Newton's method on soft labels, each row counting ``times``; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    times = np.ones(len(x)) if times is None else times
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * (q * (1 - q) + 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (times * (q - p)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict:
    """The model: stems, weights, accuracy and correlation of the voters. docs: (doc_id, text) of training rows only."""
    one = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    long_lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= 40)
    copy = F.coalesce(F.array_min(F.transform(long_lines, lambda x: F.xxhash64(x))), F.xxhash64("text"))  # copies share their least long line
    texts = docs.select("doc_id", "text").filter("text is not null").withColumn("hash", F.xxhash64("text"))
    known = texts.select("doc_id", "hash", copy.alias("copy")).join(one, "doc_id")  # three numbers a text are shuffled, not the text
    keys = written(known.groupBy("toxic", "copy").agg(F.min(F.struct("doc_id", "hash")).alias("row")).select("toxic", "row.*"), "toxicity-keys")
    counts = {r["toxic"]: r["n"] for r in keys.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = written(least_by_hash(keys, "toxic", counts, {1: max_toxic, 0: max_clean}), "toxicity-chosen")
    # at most max_toxic + max_clean rows are broadcast, and as many texts kept
    sample = written(texts.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "toxic"), "toxicity-sample")
    drop(keys, chosen)
    mined = [s for s in mine_stems(sample) if s.rstrip("*") not in LEXICON]
    stems = [*LEXICON, *mined]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(stems)
        for df in batches:
            yield pd.DataFrame({"toxic": df["toxic"], "x": [features(t, hits, len(stems)) for t in df["text"]]})

    rows = sample.mapInPandas(extract, "toxic int, x array<double>").toPandas()  # bounded, see chosen
    drop(sample)
    if not len(rows):
        return {"stems": stems, "weights": np.append(np.zeros(len(stems) + N_PATTERNS), -3.0), "accuracy": np.zeros(0), "correlation": np.zeros((0, 0)), "posterior": np.zeros(0)}
    x = np.stack(rows["x"].to_list())
    v = votes(x, len(LEXICON), len(stems))
    sizes = {1: max_toxic, 0: max_clean}
    times = rows["toxic"].map({k: n / min(n, sizes[k]) for k, n in counts.items()}).to_numpy(float)
    p, accuracy, correlation = label_model(v, times=times)
    return {"stems": stems, "weights": fit_logistic(x, p, times=times), "accuracy": accuracy, "correlation": correlation, "posterior": p}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of docs with score and predicted."""
    stems, weights = model["stems"], model["weights"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(stems)
        for df in batches:
            logits = np.array([features(t, hits, len(stems)) @ weights[:-1] + weights[-1] for t in df.pop("__text")])
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield df.assign(score=p, predicted=(p >= THRESHOLD).astype(int))

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(apply, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for all rows, learned from labelled rows that aren't held out."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return score(marked, fit(marked.filter(~F.col("held_out")), labels, **how), ("doc_id", "held_out"))
