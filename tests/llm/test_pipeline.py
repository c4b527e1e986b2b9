"""run(): each stage's rows against plain Python on what the stage before kept, and the last stage's pieces."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from missiva.llm import packing, quality
from missiva.llm.common import written
from tests.llm.test_operators import SCHEMA, WORD, make_docs, members, source_targets, without_shared_lines

SPACE = " \t\n\x0b\f\r"
LAST = (1 << 63) - 1


def clean(text):
    """The text without failing lines; None if the document goes."""
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return None

    def passes(line):
        if not line.strip(SPACE):
            return True
        symbols = len(re.findall(quality.SYMBOLS, line))
        separators = len(re.findall(rf"(?:^|[{SPACE}])[|»›•·>](?:[{SPACE}]|$)", line))
        return bool(re.search(quality.SENTENCE_MARKS, line)) and 10 * symbols <= len(line) and separators < 3 and not any(b in line.lower() for b in quality.BOILERPLATE)

    kept = "\n".join(x for x in text.split("\n") if passes(x))
    return kept if len(words) - len(WORD.findall(kept)) <= 0.5 * len(words) else None


def copies(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = source_targets(sizes)
    out = []
    for r in rows:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        name = "null" if r["doc_id"] is None else r["doc_id"]
        drawn = int(hashlib.md5(f"mix-1|{name}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (drawn < rate - math.floor(rate)))
    return out


def test_run(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    docs = make_docs()
    docs += [(200 + i, docs[40 + i][1] + "\nA last line that no other document has, number %d." % i, "en", "a", 1, *["clash"] * 7) for i in range(4)]
    lines = "\n".join(f"Line {i} of the text has some words that say nothing: {i * i} and {i * 7}." for i in range(8))
    docs += [(i, lines, "en", "a", 1, *["clash"] * 7) for i in (299, 300)]  # line dedup leaves nothing of the second
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    stages = []

    def kept(df, name):
        out = written(df, name)
        stages.append((out.columns, [r.asDict() for r in out.collect()]))
        return out

    monkeypatch.setattr(corpus_pipeline, "written", kept)
    corpus_pipeline.run(spark, str(tmp_path))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert [c for c, _ in stages[:-1]] == [names] * 4

    def same(rows, got):
        return Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r[c] for c in names) for r in got)

    def with_text(row, text):
        return row | {"text": text, "n_chars": len(text)}

    rows = [dict(zip(names, r, strict=True)) for r in docs]
    rows = [with_text(r, t) for r in rows if (t := clean(r["text"])) is not None]
    assert rows and same(rows, stages[0][1])

    left = without_shared_lines([(r["doc_id"], r["text"]) for r in rows])
    rows = [with_text(r, t) for r, (_, dropped, t) in zip(rows, left, strict=True) if not (dropped and not t.strip(SPACE))]
    assert same(rows, stages[1][1]) and all(WORD.search(r["text"]) for r in rows) and not any(r["doc_id"] == 300 for r in rows)

    groups = defaultdict(list)
    for r, (_, name) in zip(rows, members([(r["doc_id"], r["text"]) for r in rows]), strict=True):
        groups[name].append(r)
    rows = [min(g, key=lambda r: LAST if r["doc_id"] is None else r["doc_id"]) for g in groups.values()]
    assert same(rows, stages[2][1])

    rows = copies(rows)
    assert same(rows, stages[3][1])

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    sizes = Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in rows)
    pieces = stages[4][1]
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == sizes
    ends = sorted((p["sequence_id"] * packing.LENGTH + p["offset"], p["length"]) for p in pieces)
    assert [a for a, _ in ends] == [0, *(a + n for a, n in ends[:-1])] and sum(n for _, n in ends) == sum(n * c for (_, n), c in sizes.items())
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "t")
        assert docs.count() == 0, name
