"""Operator 4, packing: concatenate and cut.

First pass: texts become token ids, one worker task at a time, and go to the shared folder as ``id_bytes`` bytes an id (two;
four for vocabularies of over 65,536 pieces, whose ids would else be refused with an error) with the task's number and each document's offset within the task. The tasks' token totals, one row a task, are summed
in prefix to give each task's global offset. Second pass: each document knows where it begins in the one long stream;
windows of ``length`` cut it there, and every piece carries its sequence and offset, so a sequence is its pieces in
order. Only the very last sequence is not full.

Ids are those of the byte-level BPE file named ``byte_bpe_50k`` (``tokenizers`` and ``tiktoken`` read the same
vocabulary; tests hold both against each other, and the faster one is used here). The file's added token's string in a
text is ordinary text, or with ``special`` the one id SPECIAL_ID, as ``tokenizers`` reads it by default; the query and the
pipeline ask for that. ``end_id`` follows each document.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id is kept; an
empty table gives an empty result; extra columns are not read. Memory: a slice of texts and its ids at a time.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import written

LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json, which the ranks don't hold.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
SLICE_CHARS = 2_000_000
#: Runs of white space from this length on overflow the encoder's own splitter; such texts are split here.
LONG_SPACE = 2000

_encodings: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str | None = None):
    """The vocabulary's encoder, loaded once a process."""
    path = path or vocabulary_path()
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_ids(text: str, vocabulary: str | None = None, special: bool = False) -> list[int]:
    """The ids of one text, however long its runs of white space are; ``special``: SPECIAL is one id."""
    if special and SPECIAL in text:
        first, *rest = (token_ids(part, vocabulary) for part in text.split(SPECIAL))
        return first + [i for ids in rest for i in (SPECIAL_ID, *ids)]
    encoder = encoding(vocabulary)
    if len(text) < LONG_SPACE or not re.search(rf"\s{{{LONG_SPACE}}}", text):
        return encoder.encode_ordinary(text)
    import public_tokenizers
    import regex

    out: list[int] = []
    for piece in regex.finditer(public_tokenizers.PATTERN, text):
        out += encoder._encode_single_piece(piece[0].encode()) if len(piece[0]) >= LONG_SPACE else encoder.encode_ordinary(piece[0])
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of about SLICE_CHARS characters."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if chars >= SLICE_CHARS or len(ids) >= 5000:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def tokenised(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, special: bool = False, id_bytes: int = 2) -> DataFrame:
    """doc_id, part (the task), begin (tokens before it in the task), n, ids (little-endian, unsigned, of id_bytes each)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for ids, texts in _slices(batches):
            begins, counts, packed = [], [], []
            for text in texts:
                tokens = np.array([*token_ids(text, vocabulary, special), end_id], dtype=f"<u{id_bytes}")
                begins.append(at)
                counts.append(len(tokens))
                packed.append(tokens.tobytes())
                at += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "part", "begin", "n", "ids"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(narrow.mapInArrow(encode, "doc_id long, part long, begin long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, *, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, special: bool = False, id_bytes: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids (binary)."""
    tokens = tokenised(docs, vocabulary=vocabulary, end_id=end_id, special=special, id_bytes=id_bytes)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the first pass
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("first"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                out: list[tuple] = []
                for doc_id, first, n, packed in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    wide = np.frombuffer(packed, f"<u{id_bytes}").astype("<u4").tobytes()
                    at = 0
                    while at < n:
                        sequence, offset = divmod(first + at, length)
                        size = min(n - at, length - offset)
                        piece = wide[4 * at : 4 * (at + size)]
                        out.append((doc_id, at, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                        at += size
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in columns[:7]), *([pa.array(columns[7], pa.binary())] if with_ids else [])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])],
                )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))
