"""Operator 11, token counts: huge documents are encoded in overlapping chunks that are spliced where both agree.

A first pass, in place and without a shuffle, counts the documents of at most ``chunk`` bytes and cuts longer ones into
chunks of ``chunk`` + ``overlap`` characters that begin ``chunk`` characters apart; only those chunks are dealt out anew,
so one document occupies many tasks. Each chunk's scan states where the tokeniser's words begin in its two overlaps, and
how many tokens stand before each. Two neighbours are spliced at the first place that both name: tokens before it count
on the left, tokens from it on count on the right. Where no place is common (a run without a break that is longer than
the overlap), the overlap is widened over the whole following chunks, as many as failed in a row, and the round repeats
until all are aligned.

Why a common place is stable: the vocabulary's words are found by a scan from left to right without memory, and merges
stay inside a word. If both scans begin a word at p, all that follows is the same, and so is all before it, for what the
left one decided before p can't hang on more than MARGIN characters after it. p must also be a place before which NFC
never composes, and MARGIN covers the longest added token, so that none spans p unseen by the left chunk. White space is
dropped and is in no token, so a run between ASCII white space is encoded once a process and its count kept (a bounded
table); runs with their places are only asked for inside the overlaps.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows are counted each; an
empty table gives an empty result; extra columns are not read. Memory: some MB of texts at a time, one whole document, and the bounded table of
counts; a run without any break costs its own length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import drop, written

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK, OVERLAP = 32_768, 512
#: Characters of a chunk's end that no splice uses; longer than any added token and any look ahead.
MARGIN = 32
#: Counts kept in a process, of runs of at most so many bytes.
KEPT, KEPT_BYTES = 1_000_000, 64
SLICE_BYTES = 1_000_000

#: Runs between ASCII white space (U+0020 and U+0009 to U+000D), as bytes.split() has them too.
RUN = re.compile(r"[^\t-\r ]+")
#: An ASCII letter and one mark behind it at the end of a run.
ENDED = re.compile(rb"[A-Za-z][!,.:;?]\Z")
PLACES = "array<struct<p: long, c: long>>"
SCANS = f"row long, lo long, hi long, last boolean, n long, heads {PLACES}, tails {PLACES}"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_vocabulary(path: str) -> None:
    """Raises unless the file's words are found without memory and white space is in none of them."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    kinds = parts.get("pre_tokenizer") or {}
    first = (kinds.get("pretokenizers") or [kinds])[0]
    kept = [t["content"] for t in parts.get("added_tokens", ()) if len(t["content"]) > MARGIN - 8 or re.search(r"\s", t["content"]) or t["normalized"] or t["single_word"]]
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not re.search(r"\(\?<?[=!]|\\s\+", first["pattern"]["Regex"])
    if not dropped or kept:
        raise ValueError(f"{path}: the splices are proven for vocabularies that drop white space only")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _composed_seconds() -> frozenset[str]:
    """Characters that NFC may join to the one before them."""
    pairs = (unicodedata.decomposition(chr(i)) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    seconds = {chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d}
    return frozenset(seconds | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})  # and Hangul's


def begins_alone(char: str) -> bool:
    """Whether NFC leaves the border before this character alone, whatever stands there."""
    if char < "\u0300":
        return True
    first = unicodedata.normalize("NFD", char)[0]
    return not unicodedata.combining(first) and first not in _composed_seconds()


class Counter:
    """Token counts of texts under one vocabulary; one a process, with a bounded table of runs."""

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [(t.lower() if b"<|" not in t else t).split() for t in texts]  # added tokens are found before letters are lowered
        new = {run for run in set().union(*split) if run not in self.known}
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = set().union(*split)
        ends = {run for run in new if ENDED.search(run)}  # a letter and the mark behind it are two words
        parts = (new - ends) | {run[:-1] for run in ends} | {run[-1:] for run in ends}
        got = self._encoded([run for run in parts if run not in self.known])
        known = self.known
        known.update(got)
        known.update([(run, known[run[:-1]] + known[run[-1:]]) for run in ends])
        out = [sum(map(known.__getitem__, runs)) for runs in split]
        for run in [run for run in (*got, *ends) if len(run) > KEPT_BYTES]:
            known.pop(run, None)
        return out

    def _encoded(self, runs: list[bytes]) -> dict[bytes, int]:
        out = {}
        for low in range(0, len(runs), 5000):
            some = runs[low : low + 5000]
            out.update(zip(some, map(len, self.tokenizer.encode_batch_fast([r.decode() for r in some], add_special_tokens=False)), strict=True))
        return out

    def places(self, text: str, low: int, high: int, before: int) -> list[dict]:
        """Where words begin in text[low:high], with the tokens before each; ``before``: those before the run at or around low."""
        out = []
        for run in RUN.finditer(text, low):
            if run.start() >= high:
                break
            got = self.tokenizer.encode(run[0], add_special_tokens=False)
            last, end = None, 0
            for i, (word, (at, to)) in enumerate(zip(got.word_ids, got.offsets, strict=True)):
                # a character whose lower case is two may end one word and begin the next: that is no place
                if word != last and at >= end and run.start() + at < high and begins_alone(text[run.start() + at]):
                    out.append({"p": run.start() + at, "c": before + i})
                last, end = word, to
            before += len(got)
        return out

    def scan(self, text: str, chunk: int, overlap: int, first: bool, last: bool, steps: int) -> tuple[int, list[dict], list[dict]]:
        """Tokens of a chunk, and the places in its two overlaps, from the chunk's start. steps: chunks that it covers."""
        heads = [] if first else self.places(text, 0, overlap, 0)
        tails = []
        if not last:
            tail = steps * chunk
            low = max(text.rfind(c, 0, tail) for c in " \t\n\r\x0b\x0c") + 1  # a run's start
            tails = [x for x in self.places(text, low, len(text) - MARGIN, self.counts([text[:low].encode()])[0]) if x["p"] >= tail]
        return self.counts([text.encode()])[0], heads, tails


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list[bytes]]]:
    """(doc_ids, rows, texts) of some MB; null texts are empty."""
    ids, rows, texts, held = [], [], [], 0
    for batch in batches:
        for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append(doc_id)
            rows.append(row)
            texts.append(text.as_py() or b"")
            held += len(texts[-1])
            if held >= most or len(ids) >= 5000:
                yield ids, rows, texts
                ids, rows, texts, held = [], [], [], 0
    if ids:
        yield ids, rows, texts


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """(number, whether it is the last, text) of the chunks; the last may be shorter, but reaches past the overlap before it."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    for k in range(n):
        yield k, k == n - 1, text[k * chunk :] if k == n - 1 else text[k * chunk : (k + 1) * chunk + overlap]


def _first_pass(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for ids, rows, texts in _slices(batches, SLICE_BYTES):
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = dict(zip(short, counter.counts([texts[i] for i in short]), strict=True))
            yield pa.RecordBatch.from_pylist(
                [{"doc_id": d, "row": r, "n_bytes": len(t), "n_tokens": counts.get(i)} for i, (d, r, t) in enumerate(zip(ids, rows, texts, strict=True))], schema
            )
            for i in range(len(texts)):
                if i not in counts:
                    some = []
                    for k, last, text in cut(texts[i].decode(), chunk, overlap):
                        some.append({"row": rows[i], "k": k, "last": last, "text": text})
                        if len(some) == 64 or last:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some = []

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return written(narrow.mapInArrow(count, "doc_id long, row long, n_bytes long, n_tokens long, k long, last boolean, text string"), "counts")


def _scanned(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """chunks: row, lo, hi (its first and last chunk), last, text."""

    def moved(places: Iterable[dict], by: int) -> list[dict]:
        return [{"p": x["p"] + by, "c": x["c"]} for x in places]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        places = pa.list_(pa.struct([("p", pa.int64()), ("c", pa.int64())]))
        schema = pa.schema([("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("heads", places), ("tails", places)])
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                n, heads, tails = counter.scan(x["text"], chunk, overlap, x["lo"] == 0, x["last"], x["hi"] - x["lo"] + 1)
                at = x["lo"] * chunk
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "lo": x["lo"], "hi": x["hi"], "last": x["last"], "n": n, "heads": moved(heads, at), "tails": moved(tails, at)}], schema)

    return chunks.select("row", "lo", "hi", "last", "text").repartition("row", "lo").mapInArrow(scan, SCANS)


def _count_at(places: str, p: Column) -> Column:
    return F.get(F.filter(places, lambda x: x["p"] == p), F.lit(0))["c"]


def _joints(scans: DataFrame) -> DataFrame:
    """row, lo (of the right chunk), p (the first place that both name; null: none), and what the splice adds to the right chunk's count."""
    left = scans.filter("not last").select("row", (F.col("hi") + 1).alias("lo"), "tails")
    both = left.join(scans.select("row", "lo", "heads"), ["row", "lo"])
    common = F.array_intersect(F.transform("tails", lambda x: x["p"]), F.transform("heads", lambda x: x["p"]))
    p = F.array_min(common)
    return both.withColumn("p", p).select("row", "lo", "p", (_count_at("tails", F.col("p")) - _count_at("heads", F.col("p"))).alias("gain"))


def _widened(scans: DataFrame, failed: DataFrame, chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """The scans of failed documents anew: chunks between which no place was common become one, whose overlap with them is their whole length."""
    from pyspark.sql import Window

    some = scans.join(failed.select("row").distinct(), "row", "left_semi").select("row", "lo", "hi")
    flagged = some.join(failed.select("row", "lo", F.lit(0).alias("new")), ["row", "lo"], "left").withColumn("new", F.coalesce("new", F.lit(1)))
    numbered = flagged.withColumn("island", F.sum("new").over(Window.partitionBy("row").orderBy("lo")))  # one document's chunk numbers
    islands = numbered.groupBy("row", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts")).filter("parts > 1")
    members = islands.select("row", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("k"))
    texts = members.join(chunks, ["row", "k"]).groupBy("row", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("k", "last", "text"))).alias("parts"))
    end = F.size("parts") - 1
    text = F.array_join(F.transform("parts", lambda x, i: F.when(i < end, F.substring(x["text"], 1, chunk)).otherwise(x["text"])), "")
    merged = texts.select("row", "lo", "hi", F.get("parts", end)["last"].alias("last"), text.alias("text"))
    swallowed = members.select("row", F.col("k").alias("lo"))
    return scans.join(swallowed, ["row", "lo"], "left_anti").unionByName(_scanned(merged, path, chunk, overlap))


def token_counts(docs: DataFrame, *, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a tokenizers file, the same on all executors; ``overlap`` is over MARGIN and at most ``chunk``.
    """
    path = vocabulary or vocabulary_path()
    check_vocabulary(path)
    if not MARGIN < overlap <= chunk:
        raise ValueError(f"overlap is over {MARGIN} and at most chunk")
    first = _first_pass(docs, path, chunk, overlap)
    out = first.filter("k is null and n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    chunks = first.filter("k is not null").select("row", "k", "last", "text")
    if not chunks.isEmpty():
        scans = written(_scanned(chunks.select("row", F.col("k").alias("lo"), F.col("k").alias("hi"), "last", "text"), path, chunk, overlap), "scans")
        joints = written(_joints(scans), "joints")
        while not (failed := joints.filter("p is null")).isEmpty():
            before = scans, joints
            scans = written(_widened(scans, failed, chunks, path, chunk, overlap), "scans")
            joints = written(_joints(scans), "joints")
            drop(*before)
        totals = scans.filter("last").select("row", "n").unionByName(joints.select("row", F.col("gain").alias("n")))
        totals = totals.groupBy("row").agg(F.sum("n").alias("n_tokens"))
        huge = first.filter("k is null and n_tokens is null").select("row", "doc_id", "n_bytes")
        out = out.unionByName(huge.join(totals, "row").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
