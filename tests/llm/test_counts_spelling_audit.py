"""Token counts, spelling variants and the source audit against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from missiva.llm import source_audit, spelling, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, row long, n string, word string, k string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward_texts():
    rng = random.Random(5)
    parts = ["a", "B", "1", " ", "'", "s", "\n", "<|endoftext|>", "<|", "|>", "e", "́", "é", "日", "!", "ᅡ", "ᄀ", "l", " ", "‍", "😀", "İ", "Σ", "\x1c", "\x85", "word,"]
    texts = [None, "", "  ", "a" * 5000, "x1" * 1500, "it's we'll 'LL " * 200, "<|endoftext|>" * 300, "é" * 1500, "日本語テキスト" * 300, "ab <|startoftext|>cd" * 200]
    texts += ["각" * 900, "각" * 600, "ΑΣ ΟΔΟΣ" * 500, "  x\x1cy\x85z" * 400, "İI" * 1200, "!?-" * 1500, "<|ENDOFTEXT|> A," * 200, "Ab, ab. AB; ab" * 100]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 2500))) for _ in range(60)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 40), (700, 100), (token_counts.CHUNK, token_counts.OVERLAP)])
def test_token_counts(spark, none, chunk, overlap):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_counts.vocabulary_path())
    texts = awkward_texts()
    rows = [(i or None, t, "en", "s", 7, "x", "y", "z") for i, t in enumerate(texts)] + [(5, texts[5], None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, token_counts.token_counts(docs, chunk=chunk, overlap=overlap, limit=500).collect()), key=str)

    def expected(doc_id, text):
        n = len(whole.encode(text or "", add_special_tokens=False))
        return doc_id, len((text or "").encode()), n, n > 500

    assert got == sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert token_counts.token_counts(none).count() == 0


def test_splices_are_taken_and_widened(spark):
    """A text with breaks is spliced in its overlaps; one without a break is widened until one chunk is left."""
    path = token_counts.vocabulary_path()
    docs = spark.createDataFrame([(1, "some words of a text " * 100), (2, "a" * 1000 + " b " * 300)], "doc_id long, text string")
    first = token_counts._first_pass(docs, path, 100, 40)
    chunks = first.filter("k is not null").selectExpr("row", "k", "last", "text")
    scans = token_counts._scanned(chunks.selectExpr("row", "k lo", "k hi", "last", "text"), path, 100, 40)
    failed = token_counts._joints(scans).filter("p is null")
    assert {r.lo for r in failed.collect()} == set(range(1, 10))
    wide = token_counts._widened(scans, failed, chunks, path, 100, 40)
    assert wide.filter("hi > lo").count() == 1
    assert token_counts._joints(wide).filter("p is null").count() == 0


def test_vocabularies_that_keep_white_space_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, vocabulary=token_counts.vocabulary_path("byte_bpe_50k.json"))


def audit_by_hand(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        others = [s for g, s in counts if g == lang]

        def rates(some):
            total = sum(counts[lang, s][t] for s in some for t in kept)
            return [1 + 10**9 * (sum(counts[lang, s][t] for s in some) + 5) // (total + 5 * len(kept)) for t in kept]

        mine, whole = rates([source]), rates(others)
        parts = {
            "pair": [(s, sum(abs(a - b) for a, b in zip(mine, rates([s]), strict=True))) for s in others if s != source],
            "term": [(t, a - b) for t, a, b in zip(kept, mine, whole, strict=True) if a > b and counts[lang, source][t]],
        }
        for part, items in parts.items():
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, f, i + 1) for i, (item, f) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize(("broadcast", "clash"), [(10**6, False), (0, False), (10**6, True)])
def test_source_audit(spark, none, monkeypatch, broadcast, clash):
    monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(source_audit, "BROADCAST_TERMS", broadcast)
    if clash:
        monkeypatch.setattr(source_audit, "term_hash", lambda term="term": F.xxhash64(term) % 3)
    rng = random.Random(8)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x2y", "don't", "a", "😀", "zed", "Zed"]
    texts = [None, "", "123 ... ", "same same same", "same same same"] + [" ".join(rng.choices(words, range(1, 12), k=rng.randint(1, 30))) for _ in range(80)]
    rows = [(t, rng.choice(["en", "fr", None, "én"]), rng.choice(["s1", "s2", "S3", None])) for t in texts] + [("only here", "zz", "s1"), ("", "zz", "s2"), (None, "yy", None)]
    docs = spark.createDataFrame([(i, t, g, s, 1, "n", "w", "k") for i, (t, g, s) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(map(tuple, source_audit.audit(docs, min_docs=3, top=4).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audit_by_hand(rows, 3, 4)
    assert any(r[0] == "zz" and r[2:5] == ("pair", "s2", 0) for r in got)
    assert source_audit.audit(none).count() == 0


def test_rates_are_exact_beyond_longs(spark):
    cases = [(0, 7, 3), (9_223_372_031, 10**10, 5), (9_223_372_032, 10**10, 5), (10**14, 3 * 10**15, 10**6), (5, 0, 1)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(source_audit.rate(F.col("c"), F.col("n"), F.col("v")).cast("long").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] and len(a) == len(b)


def variants_by_hand(rows, min_chars):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_chars and c >= 2}
    near = defaultdict(list)
    for a, b in itertools.permutations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in near}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize(("shard_words", "wave_bytes"), [(spelling.SHARD_WORDS, spelling.WAVE_BYTES), (7, 400)])
def test_spelling_variants(spark, none, shard_words, wave_bytes):
    rng = random.Random(11)
    letters = "abÀé÷×ÿz"
    words = ["".join(rng.choices(letters, k=rng.randint(3, 6))) for _ in range(40)] + ["aaaa", "aaaaa", "aaaaaa", "aaab", "baaa", "ÉTÉ", "été", "Abab", "ab"]
    for w in words[:25]:
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in words]
    rows = [(i or None, rng.choice([" ", "1", "日"]).join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, " 12 ")]
    rows += [rows[3], rows[3], (903, "chain " + "abcdef " * 3 + "abcdeg " * 31 + "abcxeg " * 330), (904, "solitary solitary")]
    docs = spark.createDataFrame([(i, t, "l", "s", 1, "n", "w", "k") for i, t in rows], SCHEMA).repartition(3)
    out = spelling.variants(docs, min_chars=3, shard_words=shard_words, wave_bytes=wave_bytes).select("word", "form", "root", "n", "n_near", "form_n")
    expected = variants_by_hand(rows, 3)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == expected
    assert any(form and form != root for _, form, root, *_ in expected)
    assert spelling.variants(none).count() == 0


def test_tries_and_waves():
    words = sorted(w.encode("latin-1") for w in {"".join(p) for k in (1, 2, 3) for p in itertools.product("aé", repeat=k)} | {"", "b", "éaéa"} if w)
    walker = spelling.Walker(spelling.Trie.unpacked(*spelling.Trie.of(words, list(range(len(words)))).packed()))
    for w in [*words, b"zz", b"aaaaa", b""]:
        near = {x: i for i, x in enumerate(words) if one_edit(x.decode("latin-1"), w.decode("latin-1"))}
        assert walker.near(w) == near
    assert list(spelling._waves([(0, 5), (1, 5), (2, 20), (3, 1)], 10)) == [[0, 1], [2], [3]]
