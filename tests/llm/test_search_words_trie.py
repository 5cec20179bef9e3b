"""Nearest neighbours, spelling variants and the prefix trie next to brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailtally.llm import nearest, prefix_trie, spelling

# nearest neighbours


def brute_nearest(rows, count):
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [(i, [float(x) for x in v]) for i, v in rows if i is not None and sound(v)]
    found = set()
    for query, q in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        others, own = [], False
        for i, v in usable:
            if not own and i == query and tuple(v) == q:
                own = True
            elif len(v) == len(q):
                dot = sum(a * b for a, b in zip(q, v))
                others.append((-dot / (math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(b * b for b in v))), i))
        found |= {(query, rank, i, score) for rank, (score, i) in enumerate(sorted(others)[:count], 1)}
    return found


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # a vector of many
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[100][1])]  # repeated, and one id on two vectors
    rows += [(2000 + i, (np.array(rows[200][1]) + 1e-4 * rng.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(250, [1.0, 2.0, 0.5]), (3000, [3.0, 1.0, 0.0]), (3001, [-0.0, 0.0, 1.0]), (3002, [0.0, -0.0, 2.0])]
    rows += [
        (None, rows[0][1]), (5000, None), (5050, []), (5100, [0.0] * 16), (5150, [math.nan] * 16),
        (5200, [None] * 16), (5250, [math.inf] + [1.0] * 15), (5300, [1e200] * 15 + [1e199]),
    ]
    found = nearest.nearest_neighbours(vectors_frame(spark, rows)).collect()
    plain = {(r.query_id, r.rank, r.vec_id): r.score for r in found}
    # The same direction, without the squares that overflow.
    expected = {k[:3]: -k[3] for k in brute_nearest([*rows[:-1], (5300, [1.0] * 15 + [0.1])], 5)}
    seen = {k: v for k, v in plain.items() if k[0] != 50}
    assert set(seen) == {k for k in expected if k[0] != 50}
    assert all(abs(seen[k] - expected[k]) < 1e-12 for k in seen)
    # Both vectors of id 50 are asked.
    assert Counter(k[:2] for k in ((r.query_id, r.rank) for r in found) if k[0] == 50) == {(50, n): 2 for n in range(1, 6)}


def test_nearest_general_interface(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(20)]
    frame = vectors_frame(spark, rows).toDF("name", "place").withColumn("rank", F.lit("x")).withColumn("dims", F.lit(1))
    found = nearest.nearest_neighbours(frame, "name", "place", queries=F.col("name") == 7, count=3).collect()
    assert [(r.query_id, r.rank) for r in sorted(found, key=lambda r: r.rank)] == [(7, 1), (7, 2), (7, 3)]
    assert {r.vec_id for r in found if r.rank < 3} == {6, 8}
    assert nearest.nearest_neighbours(frame.limit(0), "name", "place").collect() == []


def test_estimates_lie_within_their_errors():
    rng = np.random.default_rng(1)
    exact = nearest.scaled_rows(rng.standard_normal((2000, 64)))
    codes, scalars = nearest.encode(nearest.unit_rows(exact))
    assert codes.shape == (2000, 64)
    block = nearest.Coded.of(exact, codes, scalars)
    queries = nearest.unit_rows(exact[:20])
    estimates = (queries @ nearest.rotation(64)) @ block.signs.T / block.scalars
    truth = queries @ nearest.unit_rows(exact).T
    assert (np.abs(estimates - truth) <= block.errors).mean() > 0.99
    left, right = nearest.reranked(block, queries, 6)
    assert len(left) < 0.25 * truth.size
    best = np.argsort(-truth, axis=1)[:, :6]
    chosen = set(zip(left.tolist(), right.tolist()))
    assert np.mean([(q, v) in chosen for q in range(20) for v in best[q].tolist()]) > 0.97


def test_recall_on_the_given_vectors(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    expected = {k[:3] for k in brute_nearest(rows, 5)}
    found = {(r.query_id, r.rank, r.vec_id) for r in nearest.nearest_vectors(spark, data).collect()}
    assert len(found & expected) >= 0.9 * len(expected)


# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    counts = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return brute_groups({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def brute_groups(words):
    rows = {}
    for word, n in words.items():
        others = [u for u in words if near(word, u)]
        best = min(others, key=lambda u: (-words[u], u), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        rows[word] = [form, None, n, len(others), words[form] if form else None]
    for word, row in rows.items():
        root = word
        while rows[root][0]:
            root = rows[root][0]
        row[1] = root
    return {word: tuple(row) for word, row in rows.items()}


def variants_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(frame).collect()}


def test_variants_on_odd_texts(spark):
    rng = random.Random(3)
    vocabulary = ["garden", "gardens", "gardan", "grden", "möhren", "möhre", "Möhren", "ÀÉÎÕÜÿ", "élève", "élèves", "élèvez"]
    docs = [(i, " ".join(rng.choices(vocabulary, [900, 90, 9, 9, 90, 900, 3, 9, 99, 99, 9], k=300))) for i in range(60)]
    docs += [(None, "garden gardon " * 9), (7, None), (8, ""), (8, "×÷ garden×bed 12garden_gardenx\x00gardeny " * 9)]
    docs += [(9, "x" * 5000 + " "), *[(10, ("y" * 3000 + " ") * 5 + ("y" * 3001 + " ") * 25)] * 2]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("n"))
    assert variants_of(frame) == brute_variants(docs)
    assert spelling.variant_groups(frame.limit(0)).collect() == []


def test_variants_on_given_documents(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    counts = {r.word: r.n for r in spelling.word_counts(frame.select("doc_id", "text")).collect() if r.n >= 5}
    shorter = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            shorter[word[:i], word[i + 1 :]].add(word)
    pairs = set()
    for word in counts:
        for i in range(len(word) + 1):
            for u in shorter.get((word[:i], word[i:]), ()):
                pairs |= {(word, u), (u, word)}
            if i < len(word):
                pairs |= {(word, u) for u in shorter[word[:i], word[i + 1 :]] if u != word}
    n_near = Counter(a for a, _ in pairs)
    rows = spelling.spelling_variants(spark, data).collect()
    assert {r.word: (r.n, r.n_near) for r in rows} == {w: (n, n_near[w]) for w, n in counts.items()}
    best = {}
    for a, b in pairs:
        best[a] = min(best.get(a, (math.inf, "")), (-counts[b], b))
    for r in rows:
        n, form = best.get(r.word, (0, None))
        assert (r.form, r.form_n) == ((form, -n) if -n >= 5 * r.n and form else (None, None))


def test_crowded_chunks_are_divided_further(spark):
    rng = random.Random(8)
    words = {"internationali" + "".join(rng.choices("abcdefgh", k=rng.choice((13, 14)))): 5 for _ in range(400)}
    for word in list(words)[:150]:
        at = rng.randrange(len(word))
        words[word[:at] + rng.choice("xyz") + word[at + rng.choice((0, 1)) :]] = 30
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = {(a, b) for a in words for b in words if near(a, b)}
    found = [(r.word, r.other) for r in spelling.near_words(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


# prefix trie


def brute_trie(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    conversations = {c: [t[2:] for t in sorted(turns)] for c, turns in conversations.items()}
    paths = {}
    for c, own in conversations.items():
        h = crc32(str(c).encode()) % 4
        paths[c] = tuple(conversations.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, inside in members.items():
        tokens = (len(inside) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += tokens
    return sorted(
        (
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node], leaves[node],
            saved[node], hashlib.sha256(",".join(str(c) for c in sorted(inside) if paths[c] == node).encode()).hexdigest(),
        )
        for node, inside in members.items()
    )


def trie_rows(frame):
    return sorted(tuple(row) for row in prefix_trie.prefix_trie(frame).collect())


def test_trie_on_odd_conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(400), 330):
        for turn in range(rng.choice((1, 1, 2, 3, 4, 6))):
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, rng.choice(("user", None, "")), rng.choice(("a b", "a  b", None, "", "c\x85d e"))))
    rows += [(c, 0, "user", "same words here") for c in range(1000, 1400)]
    rows += [(c, 1, "user", "and again") for c in range(1000, 1300)]
    rows += [(None, 0, "user", "nobody"), (1399, 5, "user", "twice"), (1399, 5, "user", "twice")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1)).withColumn("segment", F.lit(None).cast("int"))
    assert trie_rows(frame) == brute_trie(rows)
    assert trie_rows(frame.limit(0)) == []


@pytest.mark.parametrize("segment, piece", [(4, 20), (1024, 1 << 16)])
def test_trie_of_long_conversations(spark, monkeypatch, segment, piece):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", piece)
    rows = [(c, t, "user", f"turn {t}") for c, n in ((20, 60), (21, 60), (22, 37), (40, 2), (45, 3)) for t in range(n)]
    rows += [(23, t, "user", f"turn {t if t < 30 else t + 1}") for t in range(50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(frame) == brute_trie(rows)


def test_trie_general_interface(spark):
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "a long, b long, c string, d string")
    found = [tuple(r) for r in prefix_trie.prefix_trie(frame, "a", "b", "c", "d").collect()]
    assert sum(r[1] == 0 for r in found) == 1 and sum(r[3] for r in found if r[1] == 1) <= 2


# blocks of one bucket, as near-dedup compares them


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    from trailtally.llm import near_dedup
    from trailtally.llm.components import components

    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(4)
    texts = {}
    for group in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for k in range(rng.choice((1, 2, 3))):
            copy = list(words)
            if k:
                copy[rng.randrange(60)] = "changed"
            texts[len(texts)] = " ".join(copy)
    spelled = near_dedup._shingle_table(spark.createDataFrame(list(texts.items()), "node long, text string"), 5, "one")
    apart = spark.createDataFrame([(bucket, node, node) for bucket in (7, 8) for node in texts], "bucket long, node long, component long")
    links = near_dedup._remaining_links(apart, spelled, 0.8)
    found = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {node: shingles(text) for node, text in texts.items()}
    expected = {}
    for node in texts:
        expected[node] = min(m for m in texts if len(sets[m] & sets[node]) >= 0.8 * len(sets[m] | sets[node]))
    assert {n: found.get(n, n) for n in texts} == expected
