"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from missiva.llm import chat, jaccard, knn, langid, line_dedup, mixing, packing, quality, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, kept string, doc string, w string, t string, d string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs():
    rng = random.Random(3)
    vocabulary = ["der", "the", "und", "and", "Straße", "naïve", "idiot", "x#y", "a b", "été", "LINE", "of", "to", "is"]
    texts = [None, "", " \t\n\x0b\f\r ", "one", "a b c d", "a b c d e", "Home | About | News | Contact\n", "All rights reserved.\nText text. " * 30]
    for i in range(60):
        words = [rng.choice(vocabulary) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(rng.choice([3, 60, 200]))]
        texts.append("".join(w + rng.choice([" ", " ", ". ", ".\n", "\t"]) for w in words))
    base = " ".join(f"w{i}" for i in range(200)) + "."
    for i in range(12):
        words = base.split()
        for _ in range(i * 2):
            words[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["A shared line of text here.\nown line number %d.\nA SHARED line of text here. " % i for i in range(5)]
    texts += ["long " * 30000, base, base, "one", "x\n\n\ny"]
    rows = [(i if i % 17 else (i or 0), t, "en", (None, "b", "a", "a", "ä")[i % 5], len(t or ""), *["clash"] * 7) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, texts[11], None, None, 0, *["clash"] * 7)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, rows, none):
    def expected(doc_id, text):
        t = text or ""
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        return (doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)

    out = quality.quality(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter(expected(r[0], r[1]) for r in rows)
    assert not any(r.kept and r.base_failed for r in out)
    assert any(r.kept for r in out)
    assert quality.quality(none).count() == 0


def test_quality_lines(spark):
    clean = "A plain sentence that ends well, with a clause. " * 10
    junk = "\n".join(["Home | About | News | Contact", "no mark at all here", "Accept cookies to go on.", "### *** $$$ !"])
    out = quality.quality(spark.createDataFrame([(1, clean + "\n" + junk), (2, junk * 20), (3, clean)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0].cleaned == clean and out[0].lost_words == len(junk.split())
    assert not out[1].kept
    assert out[2].cleaned == clean and out[2].lost_words == 0


def source_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(docs, rows, none):
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    by_size = {sizes[s]: t for s, t in source_targets(sizes).items()}
    for r in out:
        assert abs(r.target - by_size[r.source_size]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in out) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def without_shared_lines(pairs):
    """(lines, dropped lines, text left) for each (doc_id, text)."""

    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    pairs = [(1 << 63 if d is None else d, t) for d, t in pairs]
    holders = defaultdict(set)
    for d, text in pairs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != d)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, rows, none):
    out = line_dedup.deduplicated_lines(docs).select("doc.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    want = without_shared_lines([(r[0], r[1]) for r in rows])
    assert Counter(map(tuple, out)) == Counter((r[0], *x) for r, x in zip(rows, want, strict=True))
    three = line_dedup.deduplicated_lines(docs, min_docs=3)
    assert three.agg(F.sum("n_dropped")).first()[0] <= sum(r.n_dropped for r in out)
    assert line_dedup.deduplicated_lines(none).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = packing.pack(docs.select("doc_id", "text", "size"), length=256, with_ids=True).collect()
    assert sum(r.start == 0 for r in out) == len(rows)
    pieces = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.sequence_id].append((r.offset, r.length))
    for n, some in pieces.items():
        assert [a for a, _ in sorted(some)] == list(itertools.accumulate([0] + [b for _, b in sorted(some)][:-1]))
        assert sum(b for _, b in some) == 256 or n == max(pieces)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,))
    whole = sorted(out, key=lambda r: r.sequence_id * 256 + r.offset)
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in whole])
    for r in whole:
        if r.start == 0:
            at = r.sequence_id * 256 + r.offset
            assert tuple(stream[at : at + r.doc_tokens]) in texts[r.doc_id]
    assert packing.pack(none).count() == 0


def test_tokeniser_agrees():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for text in ("", " ", "a<|endoftext|>b", "naïve  Straße x y", "日本語 العربية 👩‍🚀", "\r\n\r\n\t  x", "0123 4,567.89", "don't I'LL we've", "x" * 3000, "\x00\x7f�"):
        assert packing.token_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in (" " * 5000, "a" + " " * 5000 + "b c\n\n" + "\n" * 3000 + " d", "\u3000" * 2500 + "x"):
        assert packing.token_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(packing.token_ids(" " * 1_000_000)) > 1000


def test_packing_reads_the_added_token(spark, tmp_path):
    """The query's and the pipeline's ids against a Tokenizer as it comes."""
    import corpus_pipeline
    from missiva.llm import queries
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " x <|endoftext|> \n y" + " " * 3000 + "<|endoftext|>", "<|endoftext", "plain text", ""]
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.packing_sequences(spark, docs, str(tmp_path))):
        pieces = defaultdict(list)
        for r in out.collect():
            pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        for i, ids in want.items():
            assert [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in sorted(pieces[i])] == sorted(pieces[i])
            assert sum(n for _, n, _ in pieces[i]) == len(ids)


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\b<", "", None, "a\\", "<part>", "é\n\n"]
    rng = random.Random(5)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "<x>\\"]), rng.choice(nasty)) for c in range(30) for t in range(rng.randrange(1, 9))]
    turns += [turns[0], turns[0], (None, None, "user", "x"), (99, 5, "assistant", "y" * 50000)]
    df = spark.createDataFrame([(*x, "clash") for x in turns], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_chats(df)
    groups = defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    read = formatted.select("conv_id", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"), "segments").collect()
    for r in read:
        want = sorted(groups[r.conv_id])
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<turn ") == len(list(itertools.groupby(want, key=lambda x: x[1])))
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c, some in groups.items():
        want = sorted(some)
        loss = "".join(x[2] for x in want if x[1] == "assistant")
        assert digests[c].n_turns == len(want) and digests[c].loss_chars == len(loss)
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in want).encode()).hexdigest()
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)], "clash") for i in range(400)]
    vectors += [(1000 + i, [1.0] * 8, "clash") for i in range(30)] + [(2000, None, ""), (2100, [float("nan")] * 8, ""), (2200, [None] * 8, ""), (2300, [float("inf")] * 8, ""), (None, [1.0] * 8, "")]
    vectors += [(3000, [0.5, 0.25], ""), (3100, [], ""), (3200, [3e6] * 8, "")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(1024 * np.pad(np.float32(v).astype(float), (0, 8 - len(v)))).astype(object)) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for block in (16384, 50):
        got = defaultdict(list)
        for r in knn.top_k(df, block=block).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        for q, a in good:
            if q % 100 == 0:
                scores = sorted(((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in good if i != q))[:10]
                assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
        assert not got
    assert knn.top_k(df.limit(0)).count() == 0


def test_top_k_of_a_repeated_query(spark):
    """Copies of a query fill the region with the best bound; its neighbours are in other regions."""
    rng = np.random.default_rng(2)
    named = spark.range(0, 100_000, 100).select("id", F.xxhash64("id", F.array(*(F.lit(x).cast("long") for x in (10240, 0, 0, 0)))).alias("h"))
    query = named.orderBy("h").first().id  # its rows are among the pivots
    vectors = [(query, [10.0, 0.0, 0.0, 0.0])] * 12
    for c, middle in enumerate(([9.0, 1.0, 0.0, 0.0], [6.0, 0.0, 5.0, 0.0], [0.0, -7.0, 0.0, 3.0], [-8.0, 0.0, 0.0, 0.0])):
        vectors += [(200_001 + 225 * c + i, [float(x) for x in middle + rng.normal(size=4) * 0.05]) for i in range(225)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    ids, q = zip(*((i, [int(x) for x in np.floor(1024 * np.float32(v).astype(float))]) for i, v in vectors), strict=True)
    asked = {i: x for i, x in zip(ids, q, strict=True) if i % 100 == 0}
    for pivots in (4, 30):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(df, max_pivots=pivots, block=100).collect())
        want = []
        for query, a in asked.items():
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in zip(ids, q, strict=True) if i != query)[:10]
            want += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
        assert got == sorted(want)


def test_warc(spark):
    pages = [(i, f"http://a.example/{i}?x=1 2", f"<p>{'é' * (i % 7)}{i % 5}</p>" * (i % 50 + 1), "clash") for i in range(300)]
    pages += [(500, None, None, ""), (501, "", "", ""), (7, pages[7][1], pages[7][2], "clash"), (None, "http://b.example", "only", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    groups = defaultdict(list)
    for p, _, html, _ in pages:
        groups[html or ""].append(p)
    out = warc.round_trip(df, roll_bytes=2000, shard_bytes=20000).collect()
    assert len(out) == len(pages)
    sha1 = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in groups}
    newest = {h: max((p for p in some if p is not None), default=None) for h, some in groups.items()}
    of_digest = {d: h for h, d in sha1.items()}
    assert Counter((r.page_id, r.payload_digest) for r in out) == Counter((p, sha1[html or ""]) for p, _, html, _ in pages)
    for r in out:
        html = of_digest[r.payload_digest]
        assert r.payload_bytes == len(html.encode())
        assert r.refers_to == (newest[html] if r.record_type == "revisit" else None)
    responses = Counter()
    for r in out:
        if r.record_type == "response":
            html = bytes(r.payload).decode()
            responses[html] += 1
            assert r.refers_to is None and r.payload_bytes == len(r.payload) and r.page_id in groups[html]
            assert r.page_id == max((p for p in groups[html] if p is not None), default=None)
        else:
            assert r.payload is None and r.refers_to is not None
    assert responses == Counter({h: 1 for h in groups})
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_shards_are_ranges(spark):
    """Shards part the page_ids into ranges of about equal bytes; rows without page_id have shards of their own."""
    from missiva.llm.common import scratch_path

    df = spark.range(400).selectExpr("if(id < 300, id * id, null) AS page_id", "'http://a' AS url", "repeat(cast(id AS string), 20 + cast(id % 7 AS int) * 30) AS html")
    manifest = warc.write_archives(df, scratch_path(spark, "warc-test"), roll_bytes=1500, shard_bytes=15000).collect()
    named = sorted((r for r in manifest if r.first_page is not None), key=lambda r: r.first_page)
    assert all(a.last_page < b.first_page and a.shard <= b.shard for a, b in zip(named, named[1:]))
    assert sum(r.records for r in manifest if r.first_page is None) == 100 and len({r.shard for r in manifest if r.first_page is None}) > 1
    records = Counter()
    for r in named:
        records[r.shard] += r.records
    assert len(records) > 5 and max(records.values()) < 4 * sorted(records.values())[len(records) // 2]


def test_warc_is_deterministic(spark):
    df = spark.range(200).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "repeat(cast(id % 9 AS string), 50) AS html")
    from missiva.llm.common import scratch_path

    seen = []
    for parts in (2, 5):
        path = scratch_path(spark, "warc-test")
        manifest = warc.write_archives(df.repartition(parts), path, roll_bytes=3000, shard_bytes=2000)
        seen.append(sorted((r.file, r.sha1, r.bytes, r.records) for r in manifest.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 2


def test_language(spark, none):
    rng = random.Random(2)
    syllables = {"en": ["the", "tion", "and", "er"], "de": ["sch", "ung", "der", "keit"], "fr": ["eau", "que", "ment", "é"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(30)), lang))
    rows += [(1001, None, "en"), (1002, "123 ...", "en"), (1003, "", None), (None, "theand tion", None), (1004, "der" * 5000, "de")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(rows)
    for i, _, lang in rows[:300]:
        assert out[i].lang_pred == lang and 0.5 < out[i].score <= 1 and out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [out[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and out[None].lang_pred == "en"
    assert langid.identify(none).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])}
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.05, 0.1, 0.15])

    def all_ways(rest):
        return 1.0 if not rest else sum(p[i] * all_ways(rest[len(x) :]) for x, i in vocabulary.items() if rest.startswith(x))

    table = np.append(p, [0, langid.UNKNOWN])[:, None]
    for word in ("a", "ab", "abab", "bbaab" * 3):
        assert np.isclose(langid.word_scores([word], vocabulary, table)[0, 0], np.log(all_ways("▁" + word)))


def test_forward_uses_long_pieces():
    vocabulary = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁abababab", "ababababab", "▁ababababababa"])}
    p = np.array([0.1, 0.1, 0.1, 0.1, 0.2, 0.25, 0.15])

    def all_ways(rest):
        return 1.0 if not rest else sum(p[i] * all_ways(rest[len(x) :]) for x, i in vocabulary.items() if rest.startswith(x))

    words = ["b", "abababab", "ababababababa", "ababababab" + "ab" * 3]
    got = langid.word_scores(words, vocabulary, np.append(p, [0, langid.UNKNOWN])[:, None])[:, 0]
    assert np.allclose(got, [np.log(all_ways("▁" + w)) for w in words])
    assert len(langid.pieces()) == 22_252 and max(map(len, langid.pieces())) == 16


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["idiot", "moron", "zzqx" + "".join(rng.choices("abc", k=3))])
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, ""), (1001, "", ""), (None, "plain words", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    table = spark.createDataFrame(labels + [labels[0]], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert out[1000].predicted == out[1001].predicted == 0 and out[1000].score == out[1001].score
    assert toxicity.toxicity(docs.limit(0), table.limit(0)).count() == 0


def test_toxicity_is_the_same_above_and_below_the_bounds(spark):
    """Scores learned from all clean rows and from a bounded sample of them, on the same texts."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2400):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        toxic = i % 10 == 0
        for _ in range(rng.choice([1, 1, 2, 3]) if toxic else rng.random() < 0.1):
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "stupid"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    logits = []
    for most in (6000, 400):
        model = toxicity.fit(docs, table, max_clean=most)
        assert model["stems"] == list(toxicity.LEXICON)
        hits, n = toxicity.Hits(model["stems"]), len(model["stems"])
        texts = [t for _, t in rows if any(hits[w] for w in t.split())]
        logits.append(np.array([toxicity.features(t, hits, n) @ model["weights"][:-1] + model["weights"][-1] for t in texts]))
    assert abs((logits[1] - logits[0]).mean()) < 0.3


def test_counting_rows_is_repeating_them():
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(80, 6 + toxicity.N_PATTERNS))) * (rng.random((80, 6 + toxicity.N_PATTERNS)) < 0.4)
    v, times = toxicity.votes(x, 3, 6), np.where(np.arange(80) % 3 == 0, 1, 4)
    many = np.repeat(np.arange(80), times)
    counted, repeated = toxicity.label_model(v, times=times.astype(float)), toxicity.label_model(v[many])
    assert np.allclose(counted[0][many], repeated[0]) and all(np.allclose(a, b) for a, b in zip(counted[1:], repeated[1:], strict=True))
    assert np.allclose(toxicity.fit_logistic(x, counted[0], times=times.astype(float)), toxicity.fit_logistic(x[many], repeated[0]), atol=1e-4)


def members(pairs):
    """(n_shingles, name of the component: a number) for each (doc_id, text)."""

    def shingles(text):
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        n = min(5, len(ws))
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()

    sets = [shingles(text) for _, text in pairs]
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def brute_components(rows):
    out = members([(r[0], r[1]) for r in rows])
    names = defaultdict(list)
    for r, (_, c) in zip(rows, out, strict=True):
        names[c].append(r[0])
    return Counter((r[0], n, min((x for x in names[c] if x is not None), default=None)) for r, (n, c) in zip(rows, out, strict=True))


def test_jaccard(docs, rows, none):
    out = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, out)) == brute_components(rows)
    assert jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("pivots,many,ringed", [(8, 1000, 24), (1, 0, 24), (1, 1000, 2)])
def test_jaccard_chains(spark, pivots, many, ringed, monkeypatch):
    """Chains of near copies, whose ends don't link, beside texts that share a passage only."""
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "RINGED", ringed)
    monkeypatch.setattr(jaccard, "RING_PART", 3)
    monkeypatch.setattr(jaccard, "HEAVY_IN_SAMPLE", 2)
    rng = random.Random(9)
    rows = []
    for c in range(4):
        words = [f"c{c}w{i}" for i in range(120)]
        for step in range(25):
            rows.append((len(rows), " ".join(words), ""))
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"o{i}x{k}" for k in range(rng.choice([5, 20, 100]))), "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)
    out = jaccard.near_duplicates(df, pivots=pivots, rounds=2).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, out)) == brute_components(rows)


def test_windows_never_drop_a_link():
    rng = np.random.default_rng(7)
    for n in (1, 5, 20, 100, 1000, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for share in (0.8, 0.85, 0.9, 1.0):
            keep = rng.random(len(x)) < share**0.5
            y = np.unique(np.concatenate([x[keep], rng.integers(0, 2**63, int((~keep).sum() * 0.5), dtype=np.uint64)]))
            if len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
                assert jaccard._may_link(jaccard.coordinates(x), len(x), jaccard.coordinates(y), len(y), 80)


def test_near_duplicates_keep_columns_of_any_name(spark):
    texts = ["one two three four five six"] * 3 + ["", None, "seven eight nine ten eleven"]
    rows = [(i, t, i * 10, "r", "w", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` long, worded string, doc string, `a.b` string")
    out = jaccard.without_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["row"] for r in out.collect()) == [0, 30, 40, 50]


def test_label_model_finds_the_posterior():
    """Votes drawn from known accuracies: the posterior is near the one that those accuracies give, and copies of a voter count less."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    right, speak = np.array([0.9, 0.8, 0.75, 0.85]), np.array([0.8, 0.6, 0.7, 0.5])
    votes = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((4000, 4)) < speak)
    p, accuracy, correlation = toxicity.label_model(votes)
    odds = np.log(0.3 / 0.7) + (votes * np.log(right / (1 - right))).sum(axis=1)
    exact = 1 / (1 + np.exp(-odds))
    assert np.abs(p - exact).mean() < 0.08 and np.mean((p > 0.5) == (exact > 0.5)) > 0.95
    assert np.abs(accuracy - right).max() < 0.1 and np.abs(correlation - np.eye(4)).max() < 0.3
    doubled = np.hstack([votes, votes[:, [2]], votes[:, [2]], votes[:, [2]]])
    again, _, found = toxicity.label_model(doubled)
    assert found[2, 4] > 0.95 and np.abs(again - exact).mean() < 0.15


def test_logistic_fit_is_the_minimum():
    rng = np.random.default_rng(5)
    x, p = rng.normal(size=(300, 4)), rng.random(300)
    w = toxicity.fit_logistic(x, p)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (np.log1p(np.exp(z)) - p * z).sum() + 0.05 * (w[:-1] ** 2).sum() + 0.0005 * w[-1] ** 2

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(size=(200, 5)) * 0.02)


def segmentations(word, vocabulary):
    """All ways to cut the word into pieces, as lists of their numbers."""
    if not word:
        return [[]]
    return [[i, *rest] for x, i in vocabulary.items() if word.startswith(x) for rest in segmentations(word[len(x) :], vocabulary)]


def test_pieces_are_fitted_as_by_enumeration():
    vocabulary = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])}
    words, counts = ["ab", "abba", "a", "babab"], np.array([3.0, 1.0, 2.0, 5.0])
    p = np.full(len(vocabulary), 1 / len(vocabulary))
    for rounds in (1, 2, 5):
        want = p.copy()
        for _ in range(rounds):
            got = np.zeros(len(p))
            for word, n in zip(words, counts, strict=True):
                ways = segmentations("▁" + word, vocabulary)
                weight = np.array([np.prod(want[w]) for w in ways])
                for w, x in zip(ways, n * weight / weight.sum(), strict=True):
                    np.add.at(got, w, x)
            want = got / got.sum()
        assert np.allclose(langid.fit_pieces(words, counts, vocabulary, rounds), want)


def test_prediction_is_the_posterior(spark):
    vocabulary = langid.pieces()
    rng = np.random.default_rng(11)
    table = np.vstack([rng.random((len(vocabulary), 3)), np.zeros((1, 3)), np.full((1, 3), langid.UNKNOWN)])
    priors = np.log([0.5, 0.3, 0.2])
    texts = ["the und", "été 12", "ab ab ab", "...", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(df, ["x", "y", "z"], priors, table).collect()}
    for i, text in enumerate(texts[:3]):
        total = priors.copy()
        for word in re.findall(r"[^\W\d_]+", text):
            total += np.log(sum(np.prod(table[w], axis=0) for w in segmentations("▁" + word, vocabulary)))
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert out[i].lang_pred == "xyz"[p.argmax()] and abs(out[i].score - p.max()) < 1e-9
    assert out[3].lang_pred == out[4].lang_pred == "und" and out[3].score == 0
