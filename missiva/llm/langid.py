"""Operator 8, language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces (the forward algorithm); a text's is the product over its words, whole texts always.

Training: at most ``max_docs`` documents a language, chosen by a hash of doc_id, are counted into words (partial sums
first); expectation maximisation by forward and backward passes runs as one task a language on its word counts, whose
number that bound limits. Scoring: each Python worker keeps a bounded table of the words it has met with their log
probabilities in all languages, so that a text is a sum of table rows.

Words are runs of letters in lower case, with the vocabulary's word-start mark before them; runs of over LONGEST_WORD
letters count in parts of that length. Letters that no piece holds
count the same in every language.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where no language was
learned; a null doc_id has the crc32 of the empty string; ties go to the language first in code point order; repeated
rows get equal results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
MAX_DOCS = 400
ROUNDS = 4
FLOOR = 1e-7
UNKNOWN = 1e-9
TABLE_WORDS = 400_000
#: Words; longer runs of letters count in parts of LONGEST_WORD.
LONGEST_WORD = 64
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")

_pieces: dict[str | None, dict[str, int]] = {}


def pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's lower-case letter pieces, numbered; loaded once a process."""
    if path not in _pieces:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        found = sorted(
            {
                p
                for p in map(model.id_to_piece, range(model.get_piece_size()))
                if p == p.lower() and (p == START or LETTERS.fullmatch(p.removeprefix(START)))
            }
        )
        _pieces[path] = {p: i for i, p in enumerate(found)}
    return _pieces[path]


def lattice(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """ids[word, end, length]: the piece of that length that ends there; len(vocabulary) if none, + 1 for a lone unknown character."""
    none, width = len(vocabulary), max(map(len, words)) + 1
    longest = min(width, max(map(len, vocabulary)))
    ids = np.full((len(words), width + 1, longest + 1), none, np.int32)
    get = vocabulary.get
    for k, word in enumerate(words):
        word, row = START + word, ids[k]
        for end in range(1, len(word) + 1):
            here = row[end]
            for size in range(1, min(end, longest) + 1):
                piece = get(word[end - size : end])
                if piece is not None:
                    here[size] = piece
            if here[1] == none:
                here[1] = none + 1
    return ids


def forward(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, end, language], scaled, and the log of the scale: sums over all segmentations of each beginning.

    table: probability of each piece, then 0 and UNKNOWN, by language.
    """
    n, ends, sizes = ids.shape
    alpha, scale = np.zeros((n, ends, table.shape[1])), np.zeros((n, ends))
    alpha[:, 0] = 1
    for end in range(1, ends):
        total = np.zeros((n, table.shape[1]))
        for size in range(1, min(end, sizes - 1) + 1):
            if (ids[:, end, size] == len(table) - 2).all():  # no word has such a piece
                continue
            total += alpha[:, end - size] * np.exp(scale[:, end - size] - scale[:, end - 1])[:, None] * table[ids[:, end, size]]
        top = total.max(axis=1)
        top[top == 0] = 1
        alpha[:, end], scale[:, end] = total / top[:, None], scale[:, end - 1] + np.log(top)
    return alpha, scale


def word_scores(words: list[str], vocabulary: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log P(word) by language."""
    out = np.zeros((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        longest = len(words[order[at]])
        stop = at
        while stop < len(order) and stop - at < max(1, 60_000 // (longest + 3)) and len(words[order[stop]]) <= longest + 1:
            stop += 1
        some = order[at:stop]
        alpha, scale = forward(lattice([words[i] for i in some], vocabulary), table)
        last = np.array([len(words[i]) + 1 for i in some])
        rows = np.arange(len(some))
        with np.errstate(divide="ignore"):
            out[some] = np.maximum(np.log(alpha[rows, last]) + scale[rows, last, None], -700.0 * last[:, None])
        at = stop
    return out


def fit_pieces(words: list[str], counts: np.ndarray, vocabulary: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation."""
    size = len(vocabulary)
    p = np.ones(size) / size
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    groups = [order[i : i + 2000] for i in range(0, len(order), 2000)]
    lattices = [lattice([words[i] for i in g], vocabulary) for g in groups]
    for _ in range(rounds):
        got = np.zeros(size + 2)
        table = np.append(p, [0, UNKNOWN])[:, None]
        for g, ids in zip(groups, lattices, strict=True):
            alpha, scale = forward(ids, table)
            n, ends, sizes = ids.shape
            last = np.array([len(words[i]) + 1 for i in g])
            rows = np.arange(n)
            beta, down = np.zeros((n, ends)), np.zeros((n, ends))  # beta times exp(down)
            beta[rows, last] = 1
            whole = np.log(np.maximum(alpha[rows, last, 0], 1e-300)) + scale[rows, last]
            weight = counts[g]
            for end in range(ends - 1, 0, -1):
                live = end <= last
                for size_ in range(1, min(end, sizes - 1) + 1):
                    from_ = end - size_
                    piece = ids[:, end, size_]
                    step = table[piece, 0] * beta[:, end]
                    use = live & (step > 0)
                    if not use.any():
                        continue
                    log_step = np.log(step[use]) + down[use, end]
                    np.add.at(got, piece[use], weight[use] * np.exp(np.log(np.maximum(alpha[use, from_, 0], 1e-300)) + scale[use, from_] + log_step - whole[use]))
                    old = np.where(beta[use, from_] > 0, np.log(np.maximum(beta[use, from_], 1e-300)) + down[use, from_], -np.inf)
                    new = np.logaddexp(old, log_step)
                    beta[use, from_], down[use, from_] = 1.0, new
        total = got[:size].sum()
        p = got[:size] / total if total else p
    return p


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def least_by_hash(rows: DataFrame, key: str, counts: dict, most: dict) -> DataFrame:
    """The most[k] rows (doc_id, key) of each key k with the least hashes of doc_id.

    counts (at least the number of rows of each key) gives a bound for the hashes that four times as many rows are
    expected under, so that a key's ranking sees few rows however many it has.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = [F.when(F.col(key) == k, part < min(1.0, (4 * most[k] + 1000) / max(1, n))) for k, n in counts.items()]
    if not near:
        return rows.limit(0)
    by_hash = Window.partitionBy(key).orderBy("_part", "doc_id")
    limit = F.coalesce(*(F.when(F.col(key) == k, m) for k, m in most.items()))
    ranked = rows.withColumn("_part", part).filter(F.coalesce(*near)).withColumn("_n", F.row_number().over(by_hash))
    return ranked.filter(F.col("_n") <= limit).select(*rows.columns)


def fit(docs: DataFrame, *, max_docs: int = MAX_DOCS, vocabulary: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, their log priors, piece table) from (doc_id, text, lang); rows without text or lang are left out."""
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    chosen = least_by_hash(known.select("doc_id", "lang").distinct(), "lang", shares, {x: max_docs for x in shares})
    sample = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # at most max_docs a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for df in batches:
            for text, lang in zip(df["text"], df["lang"], strict=True):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, words in found.items():
            yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})

    words = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learn(df: pd.DataFrame) -> pd.DataFrame:
        known_pieces = pieces(vocabulary)
        df = df.sort_values("word")
        if not len(df):
            return pd.DataFrame({"lang": [], "piece": [], "p": []})
        p = fit_pieces(df["word"].tolist(), df["n"].to_numpy(float), known_pieces, rounds)
        seen = np.flatnonzero(p > FLOOR)
        return pd.DataFrame({"lang": df["lang"].iloc[0], "piece": seen, "p": p[seen]})

    learned = words.groupBy("lang").applyInPandas(learn, "lang string, piece long, p double").toPandas()  # vocabulary x languages at most
    langs = sorted(shares)
    table = np.full((len(pieces(vocabulary)) + 2, len(langs)), FLOOR)
    for lang, rows in learned.groupby("lang"):
        table[rows["piece"], langs.index(lang)] = rows["p"]
    table[-2], table[-1] = 0, UNKNOWN
    total = sum(shares.values())
    return langs, np.log(np.array([(shares[x] + 1) / (total + len(langs)) for x in langs])), table


def predict(docs: DataFrame, langs: list[str], priors: np.ndarray, table: np.ndarray, *, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of docs with lang_pred and score, the posterior probability of lang_pred."""
    model = docs.sparkSession.sparkContext.broadcast((priors, table))  # vocabulary x languages
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior, probabilities = model.value
        vocabulary_ = pieces(vocabulary)
        at: dict[str, int] = {}
        logs = np.zeros((1 << 12, len(langs)))
        for df in batches:
            out, scores = [], []
            texts = df.pop("__text").tolist()
            for low in range(0, len(texts), 200):
                split = [LETTERS.findall(t.lower()) if t else [] for t in texts[low : low + 200]]
                new = list({w for ws in split for w in ws if w not in at})
                if len(at) + len(new) > TABLE_WORDS:
                    at.clear()
                    new = list({w for ws in split for w in ws})
                if new and langs:
                    got = word_scores(new, vocabulary_, probabilities)
                    if len(at) + len(new) > len(logs):
                        logs = np.resize(logs, (2 * (len(at) + len(new)), len(langs)))
                    logs[len(at) : len(at) + len(new)] = got
                    at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                for ws in split:
                    if not langs or not any(c.isalpha() for w in ws for c in w):
                        out.append("und")
                        scores.append(0.0)
                        continue
                    total = prior + logs[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(total.argmax())
                    out.append(langs[best])
                    scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield df.assign(lang_pred=out, score=scores)

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(score, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all rows, learned from those that aren't held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    langs, priors, table = fit(marked.filter(~F.col("held_out")), **how)
    return predict(marked, langs, priors, table, vocabulary=how.get("vocabulary"), keep=("doc_id", "held_out"))
