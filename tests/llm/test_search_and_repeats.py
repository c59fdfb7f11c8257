import binascii
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from cases import DDL, documents, prose, row

from tidemark.llm import lexical, periodic, substring_dedup

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


@pytest.fixture(scope="module")
def rows():
    return documents(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


# --- 11


def terms(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute_search(rows, items, k=10):
    """Scores by their definition, for each row of items."""
    own = [(doc, Counter(terms(text))) for doc, text, *_ in rows]
    own = [(doc, c) for doc, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(asked * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, asked in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, LAST if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if doc == LAST else doc, -score] += 1
    return out


def asked(rng, rows):
    words = [w for r in rows[:40] for w in (r[1] or "").split()]
    items = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    return [*items, ("q0", "again " + words[0]), ("q0", words[0].upper() + " " + words[0]), (None, words[1]), ("none", None), ("empty", ""), ("marks", " .,;"), ("unknown", "zzzzzz"), ("copies", rows[3][1] or "x")]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, docs, rows, none, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
        monkeypatch.setattr(lexical, "SHARD_WORDS", 300)
    items = asked(random.Random(2), rows)
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id string, text string, doc_id int, score int")
    want = brute_search(rows, items)
    assert len({k[3] for k in want}) < len(want)  # there are ties
    assert multiset(lexical.op11_sharded_postings(docs, queries)) == want
    if small:
        index = lexical.built_index(docs)
        assert index.shards.count() > 10
        assert multiset(lexical.search(index, queries, block_items=3)) == want
        assert multiset(lexical.search(index, queries, block_terms=9, k=2)) == brute_search(rows, items, 2)
        numbered = spark.createDataFrame([(7, rows[3][1])], "item_id int, text string")
        assert lexical.search(index, numbered).dtypes[0] == ("item_id", "int")
    assert lexical.op11_sharded_postings(none, queries).count() == 0
    assert lexical.op11_sharded_postings(docs, queries.limit(0)).count() == 0
    assert lexical.op11_sharded_postings(none, queries.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_all_that_tie_are_looked_at():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        scores, ids = rng.integers(0, 4, n), rng.permutation(n)
        k = int(rng.integers(1, 12))
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s)[:k]
        got_ids, got = lexical.best_of(scores, ids, k)
        assert [(-s, i) for s, i in zip(got.tolist(), got_ids.tolist(), strict=True)] == want


def test_lengths_beyond_64_bits_on_the_way():
    big = [10**9, 3 * 10**8]
    assert lexical.length_factors(big, 10**12, 10**15).tolist() == [25 + 75 * n * 10**12 // 10**15 for n in big]


# --- 12


def brute_windows(rows):
    least = {}
    of = lambda doc: LAST if doc is None else doc
    for doc, text, *_ in rows:
        w = BLANK.findall(text or "")
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            least[key] = min(least.get(key, LAST), of(doc))
    out = Counter()
    for doc, text, *_ in rows:
        w = BLANK.findall(text or "")
        gone = bytearray(len(w))
        for s in range(len(w) - 49):
            if least[tuple(w[s : s + 50])] < of(doc):
                gone[s : s + 50] = b"\1" * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages(rng):
    """Passages of 45 to 130 words, whole, cut and changed, between other words and at the ends of texts."""
    stock = [prose(rng, n).split() for n in (45, 49, 50, 51, 64, 90, 130)]
    rows = []
    for i in range(70):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += prose(rng, rng.choice([0, 0, 3, 40])).split()
            own = list(rng.choice(stock))
            kind = rng.random()
            if kind < 0.25:
                own[rng.randrange(len(own))] = "changed"
            elif kind < 0.4:
                own = own[rng.randrange(8) :]
            words += own
        rows.append(row(rng.choice([i, i, 1000 - i]), rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize(("batch_bytes", "most"), [(8 << 20, substring_dedup.MOST), (3000, substring_dedup.MOST), (3000, 6), (3000, 0)])
def test_repeated_windows_equal_brute_force(spark, docs, rows, none, monkeypatch, batch_bytes, most):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    digest = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    every = rows + passages(random.Random(8))
    found = substring_dedup.without_repeated_words(spark.createDataFrame(every, DDL).repartition(3), most=most, with_text=True)
    got = found.collect()
    want = brute_windows(every)
    assert Counter(tuple(r[c] for c in digest) for r in got) == want
    assert sum(k[2] for k in want.elements()) > 3000
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substring_dedup.op12_prefix_subtrees(none).count() == 0
    assert substring_dedup.op12_prefix_subtrees(none).columns == digest


def test_prefixes_that_are_too_common_are_split(spark, monkeypatch):
    """A passage that all documents have, between words of their own, with few suffixes to a group."""
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 4000)
    rng = random.Random(4)
    shared = prose(rng, 70).split()
    rows = [row(i, " ".join(prose(rng, rng.randint(0, 60)).split() + shared[i % 5 :] + prose(rng, rng.randint(0, 60)).split())) for i in range(60)]
    want = brute_windows(rows)
    for most in (10, substring_dedup.MOST):
        assert multiset(substring_dedup.without_repeated_words(spark.createDataFrame(rows, DDL), most=most).drop("n_spans")) == want


def test_windows_in_periodic_texts(spark):
    texts = ["a " * 300, "a " * 70 + "b " + "a " * 49, "a b " * 100, "b a " * 60 + "x", "a b c " * 40, "x " + "a b c " * 30, "a " * 49, "a " * 50, "\x00 \x85 " * 40, "q \x00 \x85 " + "\x00 \x85 " * 30]
    rows = [row(9 - i, t) for i, t in enumerate(texts)]
    for most in (0, 1, 100):
        assert multiset(substring_dedup.without_repeated_words(spark.createDataFrame(rows, DDL), most=most).drop("n_spans")) == brute_windows(rows)


def test_grams_are_of_all_their_words():
    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(977)
    for size in (1, 2, 7, 8, 16, 50):
        whole = substring_dedup.grams(words, size)
        assert len(whole) == len(words) - size + 1
        for at in (0, 31, len(whole) - 1):
            assert substring_dedup.grams(words[at : at + size].copy(), size)[0] == whole[at]
            for k in range(size):
                other = words[at : at + size].copy()
                other[k] += np.uint64(1)
                assert substring_dedup.grams(other, size)[0] != whole[at]


def test_words_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 7)
    text = (prose(random.Random(1), 200) + "  x" * 30 + "y" * 50).encode()
    assert [w for p in substring_dedup.pieces(text) for w in p.split()] == text.split()


def test_shards_of_groups_grow_with_the_corpus():
    for total in (0, 10**9, 10**12, 10**14):
        shards = substring_dedup.shard_count(total)
        per_row, per_shard = substring_dedup.BATCH_BYTES / 108 / shards, total / 108 / shards
        assert shards >= 8 and per_shard <= 2_000_000 and (per_row >= 31 or per_shard > 1_900_000 or shards == 9)


# --- 13


def brute_runs(w):
    n, out, seen = len(w), [], set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size = i + p - s
            if size >= max(12, 2 * p) and (s, size) not in seen:
                seen.add((s, size))
                out.append((s, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(rows):
    out = Counter()
    for doc, text, *_ in rows:
        w = BLANK.findall(text or "")
        if doc is not None and w:
            h = binascii.crc32(str(doc).encode())
            if h % 10 == 0:
                g, n = h // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{size},{p}\n" for s, size, p in runs)), digest(kept)] += 1
    return out


def repetitive(rng, n):
    rows = []
    for i in range(n):
        k = rng.choice([1, 2, 3, 5, 30])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6 and w:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randint(2, 10)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
        rows.append(row(300 + i, " ".join(w)))
    return rows


def test_periodic_runs_equal_brute_force(spark, docs, rows, none, monkeypatch):
    every = rows + repetitive(random.Random(6), 250)
    found = periodic.op13_harmonic_grid(spark.createDataFrame(every, DDL).repartition(3))
    want = brute_periodic(every)
    assert multiset(found) == want
    assert sum(k[1] > 1 for k in want) > 10 and any(k[0] is not None and k[0] < 300 and k[1] for k in want)
    assert periodic.op13_harmonic_grid(none).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic.periodic_runs(docs.withColumn("runs", docs["t"]), keep=["runs"])


@pytest.mark.parametrize("extensions", [periodic.by_hashes, periodic.by_names])
def test_runs_in_blocks_of_any_size(monkeypatch, extensions):
    rng = random.Random(9)
    texts = [(r[1] or "").split() for r in repetitive(rng, 120)]
    names = [np.array([int(x[1:]) for x in t], dtype=np.int64) for t in texts]
    want = [brute_runs(t) for t in texts]
    monkeypatch.setattr(periodic, "LONG", 12)
    assert periodic.runs_of(names, extensions) == want
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 50)
    assert periodic.runs_of(names, extensions) == want
    for at_once in (5, 64):
        for t, own in zip(names, want, strict=True):
            if len(t):
                (_, start, length, period), right = periodic.found_runs(t, np.array([len(t)]), extensions, at_once)
                assert right and list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == own


def test_texts_on_which_hashes_err():
    """Hashes that take different words for equal ones find runs that are none, or too long ones; names find the right ones."""
    rng = random.Random(11)
    texts = [(r[1] or "").split() for r in repetitive(rng, 60)]
    names = [np.array([int(x[1:]) for x in t], dtype=np.int64) for t in texts]
    wrong = 0
    for words in (2, 3, 7):
        coarse = lambda ids, words=words: periodic.by_hashes(ids % words)
        wrong += sum(not periodic.found_runs(t, np.array([len(t)]), coarse)[1] for t in names if len(t))
        assert periodic.runs_of(names, coarse) == [brute_runs(t) for t in texts]
    assert wrong > 10
    word = [0]
    while len(word) < 2048:  # the sequence of Thue and Morse, on which hashes modulo 2^64 can err
        word += [1 - x for x in word]
    text = np.array(word + word[:1024] + [7] + word[1024:2048], dtype=np.int64)
    assert periodic.runs_of([text])[0] == brute_runs(text.tolist())


@pytest.mark.parametrize("text", [[0] * 300_000, [0, 1, 2] * 100_000, list(range(300_000)), [i % 1000 for i in range(300_000)]])
def test_long_texts_take_little_time(text):
    began = time.monotonic()
    runs = periodic.runs_of([np.array(text, dtype=np.int64)])[0]
    assert time.monotonic() - began < 20
    assert all(size == 300_000 for _, size, _ in runs) and len(runs) <= 1
