from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from trailtally.llm import classifier, line_dedup, lm_scoring, near_dedup, packing, quality_rules
from trailtally.llm import sentencepiece_codec as spc
from trailtally.llm.words import WordRows, coded_word_groups, hash64, word_groups

DOCS = "doc_id long, text string, lang string"


def pandas_table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").toPandas()


def held(doc_id, parts, which):
    return zlib.crc32(str(doc_id).encode()) % parts == which


# line dedup


def brute_lines(rows, min_docs=5, min_chars=40):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(space).translate(lower)

    where = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc_id)
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if len(key(line)) < min_chars or len(where[key(line)]) < min_docs or doc_id == max(where[key(line)])
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found.append((doc_id, len(lines), len(lines) - len(kept), digest))
    return sorted(found)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["x" * 39, "y" * 40, " \tY" + "y" * 38 + "y ", "É" * 45, "é" * 45, "short", "", "Z" * 60, "z" * 60 + "\r"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 130)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "Z" * 60), (102, "Z" * 60), (103, ("Z" * 60 + "\n") * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(row) for row in line_dedup.line_digests(docs).collect())
    assert found == brute_lines(rows)


def test_keep_bitmaps_are_bits_of_kept_lines(spark):
    line = "q" * 50
    docs = spark.createDataFrame([(k, "a\n" * 64 + line) for k in range(5)], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(docs).collect()
    assert {row["_id"] for row in rows} == {0, 1, 2, 3}
    assert all(row["keep_bitmap"] == {1: ~1} and row["n_dropped"] == 1 for row in rows)


# packing


def test_packing_is_whole_gapless_and_without_padding(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = [(-1, "<|endoftext|> a  b"), (-2, "x<|endoftext|><|endoftext|>\n y"), (-3, "<|endoftext"), (-4, "a\x00 \u4e2d\u6587 e\u0301")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    pieces = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for piece in pieces:
        by_doc[piece["doc_id"]].append(piece)
        by_sequence[piece["sequence_id"]].append(piece)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        place = 0
        for piece in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert piece["start"] == place and piece["doc_tokens"] == len(ids)
            place += piece["length"]
            assert piece["ids_crc32"] == zlib.crc32(ids[piece["start"] : place].tobytes())
        assert place == len(ids)
    for sequence in by_sequence.values():
        place = 0
        for piece in sorted(sequence, key=lambda p: p["offset"]):
            assert piece["offset"] == place
            place += piece["length"]
        assert place <= 1024 and place & (place - 1) == 0
        assert len({piece["length"] for piece in sequence}) == 1


def test_packing_special_tokens_are_those_of_the_vocabulary_and_capacity_is_checked(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|> a  b \n c"), (2, None)], "doc_id long, text string")
    sizes = {row["doc_id"]: row["doc_tokens"] for row in packing.pack(docs).collect()}
    assert sizes == {1: 8, 2: 1}
    # Ranks alone have no special tokens.
    plain = packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert {row["doc_id"]: row["doc_tokens"] for row in plain}[1] > 8
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=1000)


# quality classifier


def test_classifier_is_right_on_held_out_documents(spark, data):
    docs, labels = pandas_table(spark, data, "documents"), pandas_table(spark, data, "labels")
    scored = classifier.quality_scores(spark, data).toPandas()
    assert len(scored) == len(docs) and scored["score"].between(0, 1).all()
    assert (scored["held_out"] == [held(i, 5, 0) for i in scored["doc_id"]]).all()
    assert (scored["predicted"] == (scored["score"] >= 0.3)).all()
    judged = scored.merge(labels, on="doc_id")
    judged = judged[judged["held_out"]]
    assert ((judged["predicted"] == judged["quality"]).mean()) >= 0.95


def test_classifier_scores_are_the_model_by_hand():
    texts = [b"good clean words here", b"good words again", b"bad*** bad*** junk###", b"junk### bad***"]
    model = classifier.train(texts, np.array([1, 1, 0, 0]))
    known = classifier.score_words(model)
    column = pa.array([t.decode() for t in texts] + ["", "again again x"])
    found = np.concatenate([classifier.class_chances(model, known, w, b) for _, w, b in word_groups(column, known)])
    for text, chances in zip([*texts, b"", b"again again x"], found):
        words = text.split()
        parts = [model.parts[f] for word in words for f in classifier.word_features([word])[0]]
        parts += [model.parts[classifier.AGAIN] for a, b in zip(words, words[1:]) if a == b]
        logits = model.bias + (np.mean(parts, axis=0) if parts else 0)
        expected = np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(chances, expected)
    assert (found[:2, 1] > 0.5).all() and (found[2:4, 1] < 0.5).all()


# quality rules


def brute_measures(text):
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.encode().split(b"\n") if line.split()]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (
        len(words), sum(len(word.decode()) for word in words), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(marked),
    )


def test_quality_rules_base_counts(spark, data):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = quality_rules.quality_verdicts(spark, data).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_words, *rest = brute_measures(texts[row["doc_id"]])
        assert tuple(row[c] for c in quality_rules.MEASURES) == (n_words, *rest)
        failed = n_words < 20 or 100 * rest[-1] > 30 * n_words
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_quality_rules_reject_symbols_and_keep_prose(spark, data):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = [row for row in quality_rules.quality_verdicts(spark, data).collect() if not row["base_failed"]]
    junk = [r for r in rows if sum(map(texts[r["doc_id"]].count, "*$%&#")) > r["n_words"]]
    prose = [r for r in rows if not any(map(texts[r["doc_id"]].count, "*$%#|!"))]
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk)
    assert sum(r["kept"] for r in prose) >= 0.99 * len(prose)


def test_quality_rules_give_rare_languages_a_band(spark):
    rng = random.Random(4)
    words = ["the", "river", "stone", "old", "house", "ran", "under", "green", "hill", "and", "over", "small", "bridge"]

    def prose():
        return " ".join(rng.choice(words) for _ in range(120))

    def junk():
        return " ".join("".join(rng.choice("*$%&#|!?@^~<>=+") for _ in range(12)) for _ in range(120))

    rows = [(k, prose(), "en") for k in range(80)]
    rows += [(100 + k, prose(), "xx") for k in range(8)] + [(110, junk(), "xx"), (111, prose(), "yy"), (112, junk(), "zz")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {row["doc_id"] for row in quality_rules.keep_by_rules(docs).collect()}
    assert {*range(100, 108), 111} <= kept and not kept & {110, 112}
    # The rare language alone, as a stage's small input.
    few = docs.filter("lang = 'xx'")
    assert {row["doc_id"] for row in quality_rules.keep_by_rules(few).collect()} == set(range(100, 108))


def test_quality_rules_see_the_order_of_words(spark):
    rng = random.Random(5)
    follows = {"the": ["old", "tall"], "old": ["stone", "river"], "tall": ["house", "stone"], "stone": ["fell", "lay"],
               "river": ["ran", "lay"], "house": ["fell", "lay"], "ran": ["under"], "fell": ["over"], "lay": ["over", "under"],
               "under": ["a"], "over": ["a", "the"], "a": ["hill", "bridge"], "hill": ["and"], "bridge": ["and"], "and": ["the"]}
    texts = []
    for _ in range(60):
        words = ["the"]
        while len(words) < 100:
            words.append(rng.choice(follows[words[-1]]))
        texts.append(words)
    rows = [(k, " ".join(words), "en") for k, words in enumerate(texts)]
    mixed = [(k, " ".join(rng.sample(words, len(words))), "en") for k, words in enumerate(texts)]
    models = quality_rules.fit(spark.createDataFrame(rows, DOCS))
    bits = [
        {r["doc_id"]: r["bits"] for r in quality_rules.measure(spark.createDataFrame(found, DOCS), models).collect()}
        for found in (rows, mixed)
    ]
    assert all(bits[1][k] > bits[0][k] + 0.5 for k in range(60))


def test_quality_rules_measure_the_running_text(spark):
    texts = ["a bc  def\na g", "x", "", None, "  one\ttwo  three ", "\u00e9t\u00e9 A1 a", "of the of the of a the"]
    rows = [(k, text, lang) for k, text in enumerate(texts) for lang in ("en", "de", None)]
    docs = spark.createDataFrame(rows, DOCS)
    counted = collections.Counter()
    for _, text, lang in rows:
        codes, _ = quality_rules.word_codes((text or "").encode().split())
        counted.update((lang or "", int(code)) for code in codes)
    found = {(r["lang"], r["code"]): r["n"] for r in quality_rules.count_ngrams(docs).collect()}
    assert found == counted
    models = quality_rules.fit(docs)
    for row in quality_rules.measure(docs, models).collect():
        words = (row["text"] or "").encode().split()
        if not words:
            assert row["bits"] is None
            continue
        codes, _ = quality_rules.word_codes(words)
        bits = -np.log2(quality_rules.chances(models[row["lang"] or ""], codes)).sum() / len(words)
        assert math.isclose(row["bits"], bits, rel_tol=1e-5)


def test_quality_rules_hold_no_model_on_the_driver(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join("".join(rng.choices(letters, k=6)) for _ in range(200)), "en") for k in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    collected = []
    to_pandas = type(docs).toPandas

    def counted(df):
        found = to_pandas(df)
        collected.append(len(found))
        return found

    monkeypatch.setattr(type(docs), "toPandas", counted)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the model is sent to all tasks"))
    assert len(quality_rules.keep_by_rules(docs).collect()) == 30
    assert max(collected) < 100
    assert quality_rules.count_ngrams(docs).count() > 10_000


def test_quality_rules_give_the_same_for_any_blocks(spark, monkeypatch):
    rng = random.Random(7)
    words = [b"ab", b"the", b"x", "\u00e9t\u00e9".encode(), b"A1", b"river", b"Of", b"a"]
    rows = [(k // 2, b" ".join(rng.choices(words, k=30 + k)).decode(), rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(7, "", "en"), (None, None, None), (61, "\u20ac#$%" * 40 + " x" * 19, "en")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def found():
        measured = quality_rules.measure(docs, quality_rules.fit(docs)).collect()
        bits = [None if r["bits"] is None else round(r["bits"], 4) for r in measured]
        key = [(r["doc_id"], r["text"], r["lang"], *(r[c] for c in quality_rules.MEASURES)) for r in measured]
        kept = [tuple(r) for r in quality_rules.keep_by_rules(docs).collect()]
        return collections.Counter(zip(key, bits)), collections.Counter(kept)

    large = found()
    assert sum(large[0].values()) == len(rows) and 0 < sum(large[1].values()) < len(rows)
    monkeypatch.setattr(quality_rules, "MOST_WORDS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert found() == large
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quality_rules_judge_documents_without_words(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "river", "stone", "old", "house", "ran", "under", "green", "hill"]
    rows = [(k, " ".join(rng.choices(words, k=80)), "en") for k in range(40)]
    rows += [(40, None, "en"), (41, "", "en"), (42, " \n\t", "en"), (43, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {row["doc_id"]: row for row in quality_rules.quality_verdicts(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and all(found[k]["kept"] for k in range(40))
    for k in range(40, 44):
        assert found[k]["n_words"] == 0 and found[k]["bits"] is None and found[k]["base_failed"] and not found[k]["kept"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {row["doc_id"] for row in quality_rules.keep_by_rules(docs).collect()} == set(range(40))


def test_quality_rules_tell_all_bytes_apart(spark):
    words = [bytes([byte]) for byte in range(256) if not bytes([byte]).isspace()]
    assert len({tuple(quality_rules.word_codes([word])[0].tolist()) for word in words}) == len(words)
    # Also as contexts: what follows is the same, what stands before is not.
    assert len({tuple(quality_rules.word_codes([word + b"abc"])[0][-2:].tolist()) for word in words}) == len(words)
    # A model of some letters and digits takes others for rare.
    known, other = ["Q7", "\u0416\u0438", "#=", "XY"], ["Z3", "\u0427\u0458", "4]", "YX"]
    models = quality_rules.fit(spark.createDataFrame([(k, " ".join(known * 20), "en") for k in range(5)], DOCS))
    rows = [(k, f"{word} " * 30, "en") for k, word in enumerate(known + other)]
    bits = {r["doc_id"]: r["bits"] for r in quality_rules.measure(spark.createDataFrame(rows, DOCS), models).collect()}
    assert all(bits[k + len(known)] > bits[k] + 1 for k in range(len(known)))


def test_kneser_ney_chances_sum_to_one():
    words = [b"the", b"then", b"that", b"on", b"of", b"Of", b"a1", b"***"] * 3 + [b"rare"]
    codes, counts = np.unique(quality_rules.word_codes(words)[0], return_counts=True)
    levels = quality_rules.kneser_ney(codes, counts)
    for code in quality_rules.word_codes([b"thz", b"xx"])[0]:
        every = (code // 64) * np.uint32(64) + np.arange(64, dtype=np.uint32)
        assert math.isclose(quality_rules.chances(levels, every).sum(), 1.0, rel_tol=1e-9)


# near-dedup


def brute_classes(texts, least=0.8):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: shingles(text) for k, text in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = collections.defaultdict(list)
    for k, found in sets.items():
        for shingle in found:
            where[shingle].append(k)
    common = collections.Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in texts}


def test_near_dedup_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    found = {row["doc_id"]: row["class_id"] for row in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_classes(texts)


def test_near_dedup_chains_hot_groups_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    texts = {0: None, 1: " \n ", 2: "a b", 3: "A  b", 4: "a c", 5: ""}
    # A chain: each step changes a few words, the ends share little.
    for k in range(40):
        texts[100 + k] = " ".join(words[4 * k : 4 * k + 120])
    # Copies of one text with one word changed each.
    base = [f"v{rng.randrange(10**9)}" for _ in range(100)]
    for k in range(80):
        texts[200 + k] = " ".join([*base[:k], "changed", *base[k + 1 :]])
    for k in range(20):
        texts[300 + k] = " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row["doc_id"]: row["class_id"] for row in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_classes(texts)
    assert len({found[k] for k in range(100, 140)}) == 1 and len({found[k] for k in range(200, 280)}) == 1


def test_near_dedup_of_null_and_shared_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(6)]
    rows = [
        (None, texts[0]), (None, texts[0].upper()), (None, texts[1]), (None, None), (None, " "), (None, None),
        (1, texts[2]), (1, texts[3]), (2, texts[2] + " more"), (3, texts[3] + " more"), (None, texts[3] + " other"),
        (4, texts[4]), (4, texts[4]), (5, None), (5, ""), (6, texts[5]), (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.Counter(tuple(row) for row in near_dedup.near_duplicates(docs).collect())
    assert found == collections.Counter([
        *[(None, None)] * 6, (1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (4, 4), (5, 5), (5, 5), (6, 6), (6, 6)
    ])
    kept = collections.Counter((row["doc_id"], (row["text"] or "").strip().lower()) for row in near_dedup.keep_one_of_each(docs).collect())
    assert kept == collections.Counter([
        (None, texts[0]), (None, texts[1]), *[(None, "")] * 3, (1, texts[2]), (1, texts[3]), (4, texts[4]),
        (5, ""), (6, texts[5]), (6, ""),
    ])


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 2**63, 120, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:90], np.unique(rng.integers(1, 2**63, 40, dtype=np.uint64))]))
    x, y = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    own = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    found = near_dedup.prob_min_hash(own, np.concatenate([a, b]), np.concatenate([x, y]), 2, 4096)
    p, q = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
    every = p.keys() | q.keys()
    exact = sum(
        1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in every) for d in p.keys() & q.keys()
    )
    assert math.isclose(near_dedup.probability_jaccard(a, x, b, y), exact, rel_tol=1e-9)
    assert abs((found[0] == found[1]).mean() - exact) < 0.03


# LM scoring


def test_lm_base_scores_against_brute_force(spark, data):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tokens = {k: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for k, t in texts.items()}
    counts = collections.Counter(w for k, ws in tokens.items() if not held(k, 7, 2) for w in ws)
    total, types = sum(counts.values()), len(counts)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    from pyspark.sql import functions as F

    from trailtally.llm.common import held_out

    # A small head, so that most words take the join.
    rows = lm_scoring.lm_scores(docs, ~held_out(F.col("doc_id"), 7, 2), head=500).collect()
    assert len(rows) == len(texts)
    better = 0
    for row in rows:
        words = tokens[row["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert row["n_tokens"] == len(words) and row["n_known"] == sum(counts[w] > 0 for w in words)
        assert row["train_tokens"] == total and math.isclose(row["base_score"], base, rel_tol=1e-9)
        better += row["score"] > base
    assert better > 0.9 * len(rows)


def test_lm_chances_of_all_tokens_sum_to_one(spark):
    texts = [("a b a b c", "en"), ("a b d", "en"), ("x y x y", "de"), ("", "de")]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], DOCS)
    counts = lm_scoring.count_tokens(docs.select("text", "lang"))
    known = lm_scoring.vocabulary(counts, head=3, classes=8)
    members = collections.defaultdict(float)
    for place in known.words.values():
        members[int(known.classes[place])] += 10 ** known.shares[place]
    rare = [row["n"] for row in counts.collect() if row["word"] != " " and row["word"].encode() not in known.words]
    members[known.rest] = (sum(n + 1 for n in rare) + 1) / known.rest_total
    members[known.end[0]] = 10 ** known.end[1]
    assert known.tokens == 16 and known.types == 7 and len(members) == known.size
    assert all(math.isclose(total, 1.0) for total in members.values())


def test_lm_model_has_its_whole_size(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500)), "en")], DOCS)
    known = lm_scoring.vocabulary(lm_scoring.count_tokens(docs.select("text", "lang")))
    # 62 classes of frequent words, the ends of texts, and all rarer words.
    assert known.size == 64
    assert lm_scoring.BATCH <= 4096


def lm_batch(size, tokens=lm_scoring.BATCH):
    """Rows of a batch, one of them used by a third of all tokens and one by all, and classes."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << lm_scoring.FEATURE_BITS, (lm_scoring.FEATURES, tokens)) >> rng.integers(0, 14, (1, tokens))
    rows[0, rng.random(tokens) < 0.3] = 7
    rows[1] = 3
    return rows, rng.integers(0, size, tokens)


@pytest.mark.parametrize("scale", [0.0, 1.0, 100.0])
@pytest.mark.parametrize("tokens", [1, 50, lm_scoring.BATCH])
def test_lm_step_against_plain_gradients(scale, tokens):
    size, (rows, classes) = 9, lm_batch(9, tokens)
    start = np.random.default_rng(2).normal(0, scale, ((1 << lm_scoring.FEATURE_BITS) + 1, size)).astype(np.float32)
    model = lm_scoring.Weights(size, start)
    values, moved = start.astype(np.float64), np.full(len(start), 1e-3)
    for _ in range(2):
        logits = values[-1] + values[rows].sum(axis=0)
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            expected = np.log(chances[np.arange(tokens), classes])
        found = model.log_chances(rows, classes)
        seen = expected > -80
        assert np.allclose(found[seen], expected[seen], rtol=1e-4, atol=1e-3)
        assert (found[~seen] < -70).all()
        error = chances
        error[np.arange(tokens), classes] -= 1
        for used in (np.full(tokens, len(start) - 1), *rows):
            gradient = np.zeros_like(values)
            np.add.at(gradient, used, error)
            moved += (gradient**2).sum(axis=1)
            values -= gradient * (lm_scoring.RATE / np.sqrt(moved))[:, None]
        model.step(rows, classes)
        assert np.allclose(model.values, values, rtol=1e-4, atol=1e-3)
        assert np.allclose(model.moved, moved, rtol=1e-3, atol=1e-3)
        # The second turn starts from the same weights, so that rounding does not add up.
        model.values[:], model.moved[:] = values, moved
        values, moved = model.values.astype(np.float64), model.moved.astype(np.float64)


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("split", [1, 9, 1 << 22])
def test_words_split_by_arrow_are_those_split_by_python(monkeypatch, lower, split):
    monkeypatch.setattr("trailtally.llm.words.SPLIT", split)
    texts = ["x", "\x1cA", " \u2003axyA日 É é\x85B\u00a0", None, "", " \t\n\x0b\x0c\r", "a A\x00 a\na ", "b" * 50, *map(chr, range(1, 300))]
    made = []
    for groups in (word_groups, coded_word_groups):
        known = WordRows(lambda words: (np.array([hash64(w) for w in words], np.uint64),), limit=40)
        columns = [pa.array(texts, pa.string()), pa.array(texts).slice(1), pa.array([], pa.string()), pa.array([None, ""], pa.string())]
        made.append([
            (part, words.tolist(), borders.tolist(), known.columns[0][words].tolist())
            for column in columns for part, words, borders in groups(column, known, lower=lower, most=5)
        ])
    assert made[0] == made[1]


def test_lm_errors_are_summed_by_row_to_the_last_bit():
    rows, _ = lm_batch(64)
    model, error = lm_scoring.Weights(64), np.random.default_rng(3).normal(size=(rows.shape[1], 64)).astype(np.float32)
    for used in rows:
        order = np.argsort(used, kind="stable")
        distinct, starts = np.unique(used[order], return_index=True)
        expected = np.add.reduceat(error[order], starts, axis=0)
        found, total = model._gathered(used, error)
        back = np.argsort(found)
        assert (found[back] == distinct).all() and (total[back] == expected).all()


def test_lm_step_works_in_the_memory_of_the_last_one():
    import tracemalloc

    rows, classes = lm_batch(64)
    model = lm_scoring.Weights(64)
    model.step(rows, classes)
    tracemalloc.start()
    try:
        model.step(rows, classes)
        model.log_chances(rows, classes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # One array of logits has a megabyte.
    assert peak < 4 * 64 * lm_scoring.BATCH


# SentencePiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The vocabulary with scores like log chances, read as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(spc.MODEL), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for number, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = -math.log(number + 2)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


TEXTS = ["", " ", "a  b", " a ", "tab\tline\nend", "日本語 x\x00y", "<s> </s> <unk>", "ＡＢ① é é", "the cat sat on the mat %%%"]


def test_sentencepiece_agrees_with_the_library_on_a_unigram_model(spark, data, unigram):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=unigram), spc.Codec(unigram)
    texts = [row["text"] for row in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    for text in [*TEXTS, *(line for text in texts for line in text.split("\n"))]:
        mine, theirs = own.encode(text).tolist(), library.encode(text)
        if mine != theirs:
            # Equal sums may be divided differently.
            assert math.isclose(sum(own.scores[i] for i in mine), sum(own.scores[i] for i in theirs), rel_tol=1e-6)


def test_sentencepiece_viterbi_against_all_segmentations(unigram):
    own = spc.Codec(unigram)
    scores = {own.pieces[i]: own.scores[i] for i in range(len(own.pieces)) if own.spelled[i]}

    def best(text):
        if not text:
            return 0.0
        return max(scores[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores)

    for word in ("▁then", "▁thing", "▁onthe", "▁%%%"):
        assert math.isclose(sum(own.scores[i] for i in own.viterbi(word)), best(word))


def test_sentencepiece_round_trip(spark, data):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    back = {row["doc_id"]: row["text"] for row in spc.decode(spc.encode(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate([*TEXTS, None])}
    assert all(row["round_trip"] for row in spc.document_pieces(spark, data).collect())


def test_word_rows_stay_bounded():
    known = WordRows(lambda words: (np.array([hash64(w) for w in words], np.uint64),), limit=10)
    column = pa.array([" ".join(f"w{k * 7 + j}" for j in range(7)) for k in range(20)])
    for part, words, borders in word_groups(column, known, most=5):
        for k, text in enumerate(column[part.start : part.stop].to_pylist()):
            expected = [hash64(w.encode()) for w in text.split()]
            assert known.columns[0][words[borders[k] : borders[k + 1]]].tolist() == expected
        assert len(known) <= 17
