import binascii
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from cases import DDL, documents, prose, row

from tidemark.llm import common, components, decontam, html_extract, license_scan, line_dedup, packing, pii, quality, sharding, simhash, suffix_dedup
from tidemark.sources import tables

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


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


def test_words_equal_the_patterns():
    for text in ("Ab-c 9É ß_x\n\x7f\x80", "ÉÑ Z", "", "A\x0bB\x1cC\x85D E"):
        assert [w.decode() for w in common.alnum_words(text.encode())] == ALNUM.findall(text.translate(LOWER))
        assert [w.decode() for w in common.blank_words(text.encode())] == BLANK.findall(text.translate(LOWER))


# --- 1


def lines_left(rows, least):
    sites, first = defaultdict(set), {}
    for doc, text, _, source, *_ in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else ():
            if source is not None:
                sites[line].add(source)
            if doc is not None:
                first[line] = min(first.get(line, doc), doc)
    out = Counter()
    for doc, text, *_ in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if len(sites[x.strip(" ")]) < least or x.strip(" ") == "" or doc == first.get(x.strip(" "))]
        out[doc, sum(x.strip(" ") != "" for x in lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark, docs, rows, none):
    found = multiset(line_dedup.op1_site_spread(docs))
    assert found == lines_left(rows, line_dedup.MIN_SITES)
    assert any(k[2] for k in found)
    joined = line_dedup.without_boilerplate(docs.select("doc_id", "source", "text"), sent_lines=0)
    told = line_dedup.without_boilerplate(docs.select("doc_id", "source", "text"))
    assert multiset(joined) == multiset(told)
    assert line_dedup.op1_site_spread(none).count() == 0
    left = line_dedup.with_lines_left(docs)
    assert left.columns == docs.columns and 0 < left.count() <= len(rows)


def test_a_null_site_is_no_site(spark):
    rng = random.Random(15)
    n = line_dedup.MIN_SITES
    sites = [f"s{i}" for i in range(n - 1)]
    rows = [row(i, "a line on one site too few\n" + prose(rng, 30), "en", s) for i, s in enumerate([*sites, None, None])]
    rows += [row(100 + i, "a line on just enough sites\n" + prose(rng, 30), "en", s) for i, s in enumerate([*sites, "s99", None])]
    docs = spark.createDataFrame(rows, DDL)
    found = multiset(line_dedup.op1_site_spread(docs))
    assert found == lines_left(rows, n)
    assert sum(k[2] for k in found.elements()) == n


# --- 2


def check_shards(found, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, docs, rows, none):
    found = sharding.op2_stratified_interleaving(docs).collect()
    check_shards(found, rows, 16)
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    assert sharding.op2_stratified_interleaving(none).count() == 0


def test_shards_match_the_mixture(spark):
    rng = random.Random(1)
    rows = [row(i, prose(rng, 3), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(4000)]
    out = sharding.sharded(spark.createDataFrame(rows, DDL), keep=["doc_id", "source"], shards=8).collect()
    check_shards(out, rows, 8)
    total = Counter(r[3] for r in rows)
    for s, n in total.items():
        for k in range(8):
            assert abs(sum(r.source == s and r.shard == k for r in out) - n / 8) <= 2


def test_small_sources_are_spread_over_the_shards(spark):
    """Thousands of one-row sources beside a large one: every shard holds both in proportion, and no slice all of the former."""
    rng = random.Random(19)
    rows = [row(i, prose(rng, 3), "en", "big" if i < 3000 else f"lone{i}") for i in range(6000)]
    out = sharding.sharded(spark.createDataFrame(rows, DDL), keep=["doc_id", "source"], shards=12).collect()
    check_shards(out, rows, 12)
    lone = Counter(r["shard"] for r in out if r.source != "big")
    # 3,000 seeded offsets fall into 12 shards at random: 250 each, with a deviation of 15
    assert len(lone) == 12 and all(abs(n - 250) < 5 * 15.2 for n in lone.values())
    pairs = [row(i, prose(rng, 3), "en", f"pair{i // 2}") for i in range(2000)]
    out = sharding.sharded(spark.createDataFrame(pairs, DDL), keep=["doc_id", "source"], shards=2).collect()
    halves = defaultdict(set)
    for r in out:
        halves[r.source].add(r["shard"])
    assert sum(len(v) == 2 for v in halves.values()) > 950  # a pair's two rows are half the sequence apart


# --- 3


def test_license_base_equals_brute_force(spark, docs, none):
    rng = random.Random(2)
    texts = [prose(rng, 20) + f" {p} " + prose(rng, 20) for p in ("Under the MIT License.", "Apache license,\nversion 2", "CC-BY-NC cc by nc", "under the mit licence", "Apache Lisense Version 2", "apache license version 3", "GNU General Public License, version 3", "nothing")]
    texts += ["cc by nc by nc cc by nc", "é" * 40 + " cc by nc " + "ß", "", None, "mit", "under the mit license under the mit license"]
    found = {r.doc_id: r for r in license_scan.op3_fuzzy_notices(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DDL)).collect()}
    phrases = {tuple(n.phrase.split()): n.label for n in license_scan.NOTICES if n.base}
    for i, t in enumerate(texts):
        words = ALNUM.findall((t or "").translate(LOWER))
        places = [(a, label) for p, label in phrases.items() for a in range(len(words)) if tuple(words[a : a + len(p)]) == p]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(",")) | {""}
    assert found[3].labels == "mit" and found[3].n_base == 0 and 0.8 < found[3].score < 1
    assert found[4].labels == "apache-2" and found[5].labels == "" and found[6].labels == "gpl-3" and found[7].score == 0
    assert license_scan.op3_fuzzy_notices(docs).count() == docs.count() and license_scan.op3_fuzzy_notices(none).count() == 0


def test_fuzzy_search_misses_nothing_within_its_edits():
    rng, s = random.Random(4), license_scan.scanner()
    for i, n in enumerate(license_scan.NOTICES):
        for _ in range(30):
            phrase = n.phrase
            for _ in range(rng.randint(0, n.edits)):
                spots = [k for k, c in enumerate(phrase) if c.isalpha() and 0 < k < len(phrase) - 1]
                k = rng.choice(spots)
                phrase = phrase[:k] + rng.choice(["q", "", phrase[k] + "z"]) + phrase[k + 1 :]
            assert any(f[0] == i for f in s.scan(s.normal(f"xx {phrase} yy".encode()))), (n, phrase)


@pytest.mark.parametrize("part", ["redistributi", "redistribution and", "redistributi ", "under the mit ", "all rights reserved ", "gnu general public license version 4 ", "é", " ", "a b "])
def test_notices_in_very_long_texts(part):
    s = license_scan.scanner()
    norm = s.normal((part * (100_000 // len(part.encode()))).encode())
    began = time.monotonic()
    found = s.scan(norm)
    assert time.monotonic() - began < 2
    assert len(found) == (5000 if part.startswith("all") else 0)


@pytest.mark.parametrize("part", ["cc by nc ", "all rights reserved ", "all rights reserve ", "under the mit license ", "apache license version 2 x ", "license "])
def test_repeated_notices_take_time_in_proportion(part):
    text = (part * (1_000_000 // len(part))).encode()
    s = license_scan.scanner()
    began = time.monotonic()
    norm = s.normal(text)
    found = s.scan(norm)
    places = s.places(norm, s.blanks(norm), found)
    assert time.monotonic() - began < 2
    base = ("cc by nc ", "under the mit license ", "apache license version 2 x ")
    per = len(part.split())
    assert [w for w, _ in places] == ([per * k for k in range(1_000_000 // len(part))] if part in base else [])


def test_notices_beside_other_letters():
    """A window is cut inside words and characters; what stands there never counts as a word's end."""
    s = license_scan.scanner()
    label = lambda text: {s.notices[i].label for i, *_ in s.scan(s.normal(text.encode()))}
    assert label("日本under the mit license") == set() and label("é under the mit licenseé") == {"mit"}  # one edit
    assert label("日本語 under the mit licensë 日本語") == {"mit"} and label("xxunder the mit licensexx") == set()
    assert label("ééé apache licénse vérsion 2 ééé") == {"apache-2"} and label("apache license version 22") == set()
    assert label("under the mit license" * 50) == set()
    norm = s.normal("日 under the mit license 語".encode())
    assert [(norm[a:b], e) for _, a, b, e in s.scan(norm)] == [(b"under the mit license", 0)]


# --- 4


def brute_fingerprint(text):
    words = BLANK.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = list(root)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def test_masks_cover():
    own = simhash.masks()
    assert len(own) == 7
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in own) for a in range(64) for b in range(64))


def test_near_groups_equal_brute_force(docs, rows, none):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = closure(fps)
    least = {}
    for (doc, *_), f in zip(rows, fps, strict=True):
        if doc is not None:
            least[root[f]] = min(least.get(root[f], doc), doc)
    want = Counter((doc, f"{f:016x}", least.get(root[f])) for (doc, *_), f in zip(rows, fps, strict=True))
    assert multiset(simhash.op4_covering(docs)) == want
    assert simhash.op4_covering(none).count() == 0


def test_links_of_large_buckets(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(300)}
    hub = rng.getrandbits(64)
    for _ in range(400):  # chains around one value: buckets over the limit
        f = hub
        for _ in range(rng.randint(1, 6)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    nodes = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "fp bigint, id bigint")
    found = {r.node % 2**64: r.root for r in components.components(simhash.links(simhash.buckets(nodes))).collect()}
    want = closure(sorted(fps))
    assert {f for f, r in want.items() if sum(x == r for x in want.values()) > 1} == set(found)
    pairs = defaultdict(set)
    for f, r in found.items():
        pairs[want[f]].add(r)
    assert all(len(v) == 1 for v in pairs.values()) and len({min(v) for v in pairs.values()}) == len(pairs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0), (200, 201)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def jaccard_groups(texts, least=simhash.ALIKE, shingle=5):
    """Sets of shingles, and the smallest index that links of ``least`` or more reach from each text."""
    words = [BLANK.findall((t or "").translate(LOWER)) for t in texts]
    sets = [frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


def test_one_of_each_group_stays(spark, docs, rows, none):
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    left = left.collect()
    _, group = jaccard_groups([r[1] for r in rows])
    best = {}
    for r, g in zip(rows, group, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda x: x[0])
    # the copies here are near enough for every pair to share a bucket
    assert Counter(r.doc_id for r in left) == Counter(r[0] for _, r in best.values())
    assert simhash.without_near_copies(none).count() == 0


def variants(rng, n, most, words=120):
    """``n`` texts of ``words`` words with up to ``most`` of them replaced at random, beginning with the one they come from."""
    base = prose(rng, words).split()
    out = [" ".join(base)]
    for _ in range(n - 1):
        own = list(base)
        for k in rng.sample(range(words), rng.randint(1, most)):
            own[k] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_masks_of_minwise_positions_cover():
    own = simhash.masks(simhash.RADIUS, simhash.POSITIONS)
    assert [m.bit_count() for m in own] == [4] * 7
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in own) for a in range(7) for b in range(7))
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 2**63, (200, 14), dtype=np.uint64)
    keys = simhash.covering_keys(sketch)
    for row in range(200):
        other = sketch[row].copy()
        other[rng.choice(7, 2, replace=False)] += np.uint64(1)  # two positions of the first group
        assert (simhash.covering_keys(other[None])[0, :7] == keys[row, :7]).any()
    assert len(np.unique(keys)) == keys.size


def test_forests_of_alike_sets():
    rng = random.Random(20)
    for _ in range(60):
        texts = [t for _ in range(3) for t in variants(rng, rng.randint(1, 12), 5, rng.choice([30, 60, 120]))]
        sets, group = jaccard_groups(texts)
        numbers = {}
        own = [np.array(sorted(numbers.setdefault(x, len(numbers)) for x in s), dtype="<u4") for s in sets]
        root = list(range(len(own)))
        pairs = simhash.alike_forest(own)
        assert all(len(sets[i] & sets[j]) >= simhash.ALIKE * len(sets[i] | sets[j]) for i, j in pairs)
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        assert root == group


@pytest.mark.parametrize("small", [1, 64])
def test_all_pairs_of_a_bucket_are_judged(spark, monkeypatch, small):
    """In memory and in blocks alike: the result is that of all pairs that share a bucket."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", 16 if small == 1 else 4096)
    rng = random.Random(17)
    texts = [t for n, most, words in ((150, 8, 400), (60, 6, 200), (60, 10, 120)) for t in variants(rng, n, most, words)] + [prose(rng, 120) for _ in range(30)]
    rng.shuffle(texts)
    sets, _ = jaccard_groups(texts)
    hashes = [simhash.shingle_set(t.encode(), 5) for t in texts]
    keys = [set(k) for k in simhash.covering_keys(simhash.minwise(hashes, 14)).tolist()]
    assert max(Counter(k for x in keys for k in x).values()) > 64
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if keys[i] & keys[j] and len(x & sets[j]) >= simhash.ALIKE * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DDL)).collect()}
    assert left == {i for i in range(len(texts)) if find(i) == i}


def test_near_copies_by_similarity_are_found(spark):
    """Copies that come in twos, in bands of similarity: found from 0.8 up, and never below."""
    rng = random.Random(18)
    texts = [t for i in range(500) for t in variants(rng, 2, 1 + i % 9, 200)]
    left = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DDL)).collect()}
    sets, _ = jaccard_groups([])
    sets = [jaccard_groups([t])[0][0] for t in texts]
    found = defaultdict(list)
    for i in range(0, len(texts), 2):
        found[int(20 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]))].append(i + 1 not in left)
    assert set(range(0, len(texts), 2)) <= left
    alike = [x for band, xs in found.items() if band >= 16 for x in xs]
    assert sum(alike) >= 0.96 * len(alike) and len(alike) > 200
    assert sum(found[16]) >= 0.9 * len(found[16]) > 30
    assert all(not any(xs) for band, xs in found.items() if band < 16) and sum(len(xs) for band, xs in found.items() if band < 16) > 50


# --- 5


def brute_removal(rows):
    least = {}
    top = 2**63 - 1
    for doc, text, *_ in rows:
        b = (text or "").encode()
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            least[k] = min(least.get(k, top), top if doc is None else doc)
    out = Counter()
    for doc, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < (top if doc is None else doc):
                gone[s : s + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("batch_bytes", [2000, 8 << 20])
def test_repeats_equal_brute_force(docs, rows, none, monkeypatch, batch_bytes):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(suffix_dedup, "SHARD_ANCHORS", 500)
    assert multiset(suffix_dedup.op5_induced_suffixes(docs)) == brute_removal(rows)
    assert suffix_dedup.op5_induced_suffixes(none).count() == 0


def test_shards_grow_with_the_corpus_and_rows_stay_full():
    gb = 10**9
    assert suffix_dedup.shard_count(0) == 8 and suffix_dedup.shard_count(gb) == gb // 18 // 200_000 + 1
    for total in (gb, 30 * gb, 1000 * gb, 100_000 * gb):
        shards = suffix_dedup.shard_count(total)
        per_row, per_shard = suffix_dedup.BATCH_BYTES / 18 / shards, total / 18 / shards
        assert per_shard <= 4_000_000 and (per_row >= 31 or per_shard > 3_900_000)


def test_repeats_in_periodic_texts(spark):
    texts = ["a" * 300, "a" * 70 + "b" + "a" * 49, "ab" * 100, "ba" * 60 + "x", "abc" * 40, "x" + "abc" * 30, "a" * 49, "a" * 50]
    rows = [row(9 - i, t) for i, t in enumerate(texts)]
    assert multiset(suffix_dedup.op5_induced_suffixes(spark.createDataFrame(rows, DDL))) == brute_removal(rows)


def test_repeats_with_runs_of_nuls(spark):
    rng = random.Random(16)
    flat = lambda n: prose(rng, n).replace("\n", "")
    shared = "before" + "\0" * 40 + "after"
    texts = [flat(30) + shared + flat(30), flat(20) + shared + flat(20), "\0" * 200, "x" + "\0" * 90 + "y", "a" * 30 + "\0" * 20, "b" + "a" * 30 + "\0" * 20]
    rows = [row(i, t) for i, t in enumerate(texts)]
    found = multiset(suffix_dedup.op5_induced_suffixes(spark.createDataFrame(rows, DDL)))
    assert found == brute_removal(rows)
    assert all(k[2] >= 50 for k in found if k[0] in (1, 3, 5))


def test_suffix_order():
    from tidemark.llm.suffix_sort import suffix_order

    rng = random.Random(1)
    for _ in range(150):
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 50))] + [0], dtype=np.uint16)
        want = sorted(range(len(text)), key=lambda i: text.tolist()[i:])
        assert suffix_order(text, 100, memory=rng.choice([0, 1 << 20])).tolist() == want


# --- 6


def brute_statistics(text):
    text = text or ""
    words = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality(spark, docs, rows, none):
    rng = random.Random(8)
    clean = [row(1000 + i, prose(rng, rng.randint(25, 300)), "en", f"s{i % 2}") for i in range(300)]
    junk = [row(2000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "s0") for i in range(10)]
    passage = prose(rng, 12)
    some = [row(3000, passage + " " + prose(rng, 60) + " " + passage, "en", "s0"), row(3001, (passage + "\n") * 9, "en", "s1")]
    everything = rows + clean + junk + some
    found = quality.op6_covariance_outliers(spark.createDataFrame(everything, DDL)).collect()
    assert Counter(tuple(r)[:-1] for r in found) == Counter((r[0], *brute_statistics(r[1])) for r in everything)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[r[0]] for r in clean) and not any(kept[r[0]] for r in junk) and not kept[3001]
    assert not any(r.kept for r in found if r.base_failed)
    assert quality.op6_covariance_outliers(none).count() == 0
    assert quality.good_documents(docs).columns == docs.columns


def test_each_statistic_rejects_by_itself(spark):
    rng = random.Random(14)
    flat = lambda n: prose(rng, n).replace("\n", "")
    clean = [row(i, "\n".join(flat(12) for _ in range(rng.randint(3, 20))), "en", "s0") for i in range(200)]
    passage = flat(36)
    alone = {
        1000: " ".join(w * 9 for w in flat(200).split()),
        1001: " ".join(w + "#" * (i % 2) for i, w in enumerate(flat(200).split())),
        1002: "\n".join(flat(15) + "\nShare\nPrint" for _ in range(15)),
        1003: "\n".join([flat(90), passage + " ra", flat(90), passage + " ne"]),
    }
    found = {r.doc_id: r for r in quality.op6_covariance_outliers(spark.createDataFrame(clean + [row(i, t, "en", "s0") for i, t in alone.items()], DDL)).collect()}
    assert all(found[r[0]].kept for r in clean)
    assert not any(found[i].base_failed or found[i].kept for i in alone)
    assert found[1002].n_repeat_words == 0 < found[1002].n_dup_lines and found[1003].n_dup_lines == 0 < found[1003].n_repeat_words


def concentrated(x, wt, core, floors):
    """Mean and covariance of rows ``core``, as the operator weighs them."""
    w = wt[core]
    m = (w[:, None] * x[core]).sum(0) / w.sum()
    d = x[core] - m
    return m, quality.CONSISTENCY * (w[:, None] * d).T @ d / (16 * len(core)) + np.diag(np.square(floors))


def brute_determinant(x, wt, rng, starts=300):
    """The smallest log determinant over many random starts, each stepped until nothing changes."""
    n, best = len(x), np.inf
    h = math.ceil(quality.CORE * n)
    for _ in range(starts):
        core = rng.choice(n, 5, replace=False)
        for _ in range(60):
            m, cov = concentrated(x, wt, core, quality.FLOORS)
            distance = wt / 16 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            new = np.argsort(distance, kind="stable")[:h]
            if set(new) == set(core):
                break
            core = new
        best = min(best, np.linalg.slogdet(concentrated(x, wt, core, quality.FLOORS)[1])[1])
    return best


def test_determinants_are_as_small_as_from_random_starts(spark):
    rng = np.random.default_rng(4)
    rows, groups = [], {}
    for g, (n, far, outliers) in enumerate(((120, 700, 0.0), (150, 500, 0.2), (200, 300, 0.24), (400, 900, 0.1), (90, 150, 0.2))):
        mix = rng.normal(size=(4, 4)) * 40
        x = rng.normal(size=(n, 4)) @ mix + [400, 200, 200, 200]
        k = int(n * outliers)
        x[:k] = rng.normal(size=(k, 4)) * 20 + np.array([400, 200, 200, 200]) + far * rng.choice([-1, 1], 4)
        x = np.clip(np.round(x), 0, quality.TOP).astype(int)
        wt = rng.integers(4, 17, n)
        groups[f"g{g}"] = (x, wt)
        rows += [(f"g{g}", *map(int, xi), int(w), 1) for xi, w in zip(x, wt, strict=True)]
    rows += [("few", 1, 2, 3, 4, 16, 1)] * (quality.LEAST_TEXTS - 1) + [("alike", 5, 5, 5, 5, 16, quality.LEAST_TEXTS)]
    cells = spark.createDataFrame(rows, "__group string, x0 bigint, x1 bigint, x2 bigint, x3 bigint, wt bigint, c bigint")
    found = {r["__group"]: r for r in quality.minimum_determinants(cells.repartition(3)).collect()}
    assert set(found) == {*groups, "alike"}
    assert (found["alike"].m0, found["alike"].l00) == (5.0, quality.FLOORS[0])
    for g, (x, wt) in groups.items():
        # a bin at the edge of the core is taken whole, which makes it larger, and the determinant with it, by a little
        assert found[g].logdet < brute_determinant(x.astype(float), wt.astype(float), rng) + 0.15, g


# --- 7


def brute_personal(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.passes_luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_personal_data_equals_brute_force():
    rng = random.Random(9)
    parts = ["@", ".", "a", "b-", "+", "1", "22", "255", "256", " ", "-", "(", ")", "4111 1111 1111 1111", "+1 (202) 555-0143", "x.y@z.com", "10.0.0.1", "é", "\n", "_", "%", "5500005555555559", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute_personal(text), text


LONG = ["1.1.1." + "0" * 50_000, "0" * 50_000 + "1.2.3.4", "1" * 100_000, "1 " * 50_000, "1." * 50_000, "a@" * 50_000, "+1" * 50_000, "+1()" * 25_000, "token=" * 16_000, "IBAN" * 25_000, "a@b" + ".c" * 50_000, "a://u:p" * 14_000]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:8])
def test_personal_data_in_very_long_texts(text):
    began = time.monotonic()
    found = [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
    assert time.monotonic() - began < 2
    if "0000" in text:
        assert found == [("ip", 0, len(text))]
    short = text[:2000]  # the naive version takes the square of the length
    assert [s for s in pii.find_spans(short) if s[0] in pii.BASE_KINDS] == brute_personal(short)


def test_further_personal_data(spark, docs, none):
    text = "IBAN: DE89 3704 0044 0532 0130 00, token = 'abc123def456ghi789' http://joe:pw@host/x iban DE88370400440532013000"
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)] == [("iban", "DE89 3704 0044 0532 0130 00"), ("secret", "abc123def456ghi789"), ("login", "http://joe:pw")]
    [got] = pii.personal_data(spark.createDataFrame([row(1, "mail a@b.cd now")], DDL), keep=["doc_id"], redact=True).collect()
    assert got.redacted == "mail <email> now" and got.n_email == 1
    assert pii.op7_anchor_expansion(none).count() == 0
    got = pii.op7_anchor_expansion(docs).first()
    assert got.base_sha256 == pii.digest([]) and got.spans == ""


# --- 8


def test_packing_round_trip(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.packed(docs, keep=["doc_id"], with_ids=True).collect()
    sequences = defaultdict(list)
    for r in found:
        assert binascii.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    # each copy of each document is there, piece by piece
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc, start, tuple(ids[start : start + length]), len(ids)) for start, length in packing.cut(len(ids)))
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in found) == want
    assert packing.op8_differencing(none).count() == 0


def test_both_encoders_agree():
    fast, slow = packing.encoders("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), packing.encoders("byte_bpe_50k.json", None)
    rng = random.Random(10)
    for text in ["a <|endoftext|> b", "don't  stop\n\n ", "", *(prose(rng, 50) for _ in range(20)), "日本語 ñandú  x\t\t9"]:
        assert list(fast(text)) == list(slow(text))


def test_windows_are_full_and_nearly_equal():
    rng = random.Random(11)
    for n in (1, 2, 7, 300):
        sizes = [rng.randint(1, 512) for _ in range(n)]
        out = packing.windows(sizes)
        sums = [sum(sizes[i] for i in w) for w in out]
        assert sorted(i for w in out for i in w) == list(range(n)) and max(sums) <= 2048
        if n == 300:
            assert max(sums) - min(sums) < 40 and len(out) <= -(-sum(sizes) // 2048) + 1
    assert packing.windows([]) == [] and packing.cut(0) == []
    assert packing.cut(5000) == [(0, 2048), (2048, 2048), (4096, 452), (4548, 452)]


# --- 9


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, a long advert text that goes on and on and on.</div>
    <article><h1>Title &amp; more</h1><p><b>First  paragraph\nof some length, with words enough.<br><p>No.</p><ul><li>One<li>Two</ul><form><p>Sign up</p></form>
    <p>Last paragraph &#233; here, with quite a lot of words to make it long.</p><div class="comments"><p>I disagree with all of this very much.</p></div></article>
    <aside>Related things</aside><footer>&copy; 2020 somebody</footer>"""
    assert html_extract.main_text(page) == "Title & more\nFirst paragraph of some length, with words enough.\nNo.\nOne\nTwo\nLast paragraph é here, with quite a lot of words to make it long."
    plain = "<div id=menu><a href=x>a</a></div><div id=content><p>" + "word " * 50 + "</p><p>Short.</p></div><div class='cookie-notice'>We use cookies on this site, yes.</div>"
    assert html_extract.main_text(plain) == ("word " * 50).strip() + "\nShort."
    for odd in (None, "", "<", "<p", "</div></div>", "<!-- x", "&#xD800;", "<script>x", "text only", "<article></article>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("text only") == "text only"


def wrapped(inner, name, outer="{}"):
    return f"<html><body><nav><a href=/>Home</a> <a href=/b>B</a></nav>{outer.format(f'<div class={name!r}>{inner}</div>')}<footer>All about us</footer></body></html>"


GOOD = [f"Paragraph {i} has a good many words of running text in it, as articles do, and so on and on." for i in range(5)]
PARAGRAPHS, LINES = "".join(f"<p>{x}</p>" for x in GOOD), "\n".join(GOOD)


@pytest.mark.parametrize("name", ["has-sidebar", "post no-comments", "layout-sidebar-right", "page header-fixed", "article-with-related", "ad-free", "entry has-comments", "sidebar", "content sidebar-left", "notice", "comments"])
def test_a_name_of_a_wrapper_empties_no_page(name):
    assert html_extract.main_text(wrapped(PARAGRAPHS, name)) == LINES
    assert html_extract.main_text(wrapped(PARAGRAPHS, name, "<main>{}</main>")) == LINES
    inner = f"<div class='cookie-notice'>We use cookies on this site, as many sites do.</div>{PARAGRAPHS}"
    assert html_extract.main_text(wrapped(inner, name)) == LINES


COMMENTS = "".join(f"<li class='comment'><p>Reader {i} writes a long comment, which goes on about everything there is to say.</p></li>" for i in range(40))
PAGES = {
    "an article's header keeps its title": (f"<article><header class='entry-header'><h1>Title</h1></header>{PARAGRAPHS}<footer class='entry-footer'>Posted in X</footer></article>", "Title\n" + LINES),
    "more comments than article": (f"<article><h1>Title</h1>{PARAGRAPHS}</article><ol class='comment-list'>{COMMENTS}</ol>", "Title\n" + LINES),
    "comments in the article": (f"<article>{PARAGRAPHS}<section id='comments'><ol>{COMMENTS}</ol></section></article>", LINES),
    "a form around the page": (f"<form id='aspnetForm'><div class='menu'><a href=x>x</a></div><div id='c'>{PARAGRAPHS}</div></form>", LINES),
    "a form in the article": (f"<article>{PARAGRAPHS}<form><p>Your name</p><input></form></article>", LINES),
    "a sidebar beside": (f"<div id='main'>{PARAGRAPHS}</div><div id='sidebar'><h3>More</h3><p>Some other thing to read, with a few words.</p></div>", LINES),
    "an unnamed column of links beside": (f"<div class='c8'>{PARAGRAPHS}</div><div class='c4'>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</div>", LINES),
    "no element at all": ("".join(f"{x}<br><br>" for x in GOOD), " ".join(GOOD)),
    "paragraphs as divisions": ("<div id='menu'><a href=x>a</a><a href=y>b</a></div><div id='content'>" + "".join(f"<div class='para'>{x}</div>" for x in ("Short one.", GOOD[0] * 6, "No.", "Yes.")) + "</div>", "\n".join(("Short one.", GOOD[0] * 6, "No.", "Yes."))),
    "a tiny article": ("<div class='ad'>An advert with quite some words in it, so that it is longer.</div><article><h1>So.</h1><p><b>Yes.<br></article><footer>A footer that is much longer than the article is.</footer>", "So.\nYes."),
    "several articles": (f"<main><article><h2>One</h2>{PARAGRAPHS}</article><article><h2>Two</h2>{PARAGRAPHS}</article></main>", f"One\n{LINES}\nTwo\n{LINES}"),
    "a table for the layout": (f"<table><tr><td class='side'><a href=x>a</a><br><a href=y>b</a></td><td>{PARAGRAPHS}</td></tr></table>", LINES),
    "hidden text": (f"<main>{PARAGRAPHS}<div hidden>Not to be seen by anybody at all.</div><p aria-hidden='true'>Nor this one here.</p></main>", LINES),
    "unclosed tags and references": ("<article><p>One &amp; two &#233;<p><b>Three<br>four<ul><li>a<li>b</ul></article>", "One & two é\nThree four\na\nb"),
    "a marked section": (f"<main><![if x]>{PARAGRAPHS}<![endif]><![foo[x]]></main>", LINES),
    "a quote that never ends": (f"<main>{PARAGRAPHS}</main><p class='x>tail", LINES),
    "white space": ("<article><p> a \u00a0\n b\t</p>\n\n<pre>c\n  d</pre></article>", "a b\nc d"),
    "repeated lines": ("<article><p>Same.</p><p>Same.</p></article>", "Same.\nSame."),
}


@pytest.mark.parametrize("name", PAGES)
def test_kinds_of_pages(name):
    page, want = PAGES[name]
    assert html_extract.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == want


def test_an_unterminated_tag_is_text():
    assert html_extract.main_text("<p>" + GOOD[0] + "<a href='x") == GOOD[0] + "<a href='x"


@pytest.mark.parametrize("part", ["<a ", "<div>", "<i><div><b>", "</i>", "<tr>", "<li>x", "<p>x", "<p><b>", "<div class=comment>", "<nav>x</nav>", "<table><tr><td>", "<dl><dt>x<dd>", "<article>x", "<!--", "<![x", "&#", "<div class='a-b has-c' id=d>"])
def test_long_and_deep_pages_take_little_time(part):
    page = part * (100_000 // len(part))
    began = time.monotonic()
    assert isinstance(html_extract.main_text(page), str)
    assert isinstance(html_extract.main_text(page + ">" + "</div>" * 5000), str)
    assert time.monotonic() - began < 4


def test_smoothing_and_clusters_equal_numpy():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 60):
        x = rng.exponential(30, n)
        k = np.exp(-(np.arange(-2, 3) ** 2) / 2)
        want = np.convolve(x, k, "full")[2 : n + 2] / np.convolve(np.ones(n), k, "full")[2 : n + 2]
        got = html_extract.smoothed(x.tolist())
        assert np.allclose(got, want)
        least = html_extract.threshold(got)
        assert any(v >= least for v in got)
    assert 10 < html_extract.threshold([3.0, 4.0, 5.0, 80.0, 90.0]) < 80


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (2, None, "<p>é x</p>", 4), (None, "v", "", 5)], "page_id bigint, url string, html string, n_chars bigint")
    assert multiset(html_extract.op9_text_to_tag(df)) == Counter([(1, "u", "", 0), (2, None, "é x", 3), (None, "v", "", 0)])
    assert html_extract.op9_text_to_tag(df.limit(0)).count() == 0


# --- 10


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = Counter()
    for doc, text, *_ in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        found = {str(i) for i in found if i is not None}
        out[doc, len(w), len(hit), len(found), decontam.items_digest(list(found)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [7, 100_000])
def test_decontamination_equals_brute_force(spark, docs, rows, none, monkeypatch, block):
    rng = random.Random(12)
    pick = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    items = [(i, " ".join(rng.choice(pick).split()[5 : 5 + rng.randint(8, 30)])) for i in range(12)] + [(50, "ra ne"), (51, "mon"), (None, "tolis"), (52, None), (53, "..."), (3, pick[0]), (54, prose(rng, 40))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    passes = []
    real = decontam.searched
    monkeypatch.setattr(decontam, "searched", lambda d, sent, **more: passes.append(sent and len(sent.value)) or real(d, sent, **more))
    found = decontam.contamination(docs, bench, keep=["doc_id"], block_windows=block)
    windows = sum(len(decontam.windows_of(common.alnum_words(t.encode()))) for _, t in items if t)
    # one pass a block, in which a task builds its tables once, and one to count words
    assert passes == ([windows] if block > 7 else [7] * (windows // 7) + [windows % 7] * (windows % 7 > 0) + [None])
    want = brute_hits(rows, items)
    found = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, decontam.items_digest(r.item_ids), r.contaminated) for r in found) == want
    assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:], strict=False))
    clean = decontam.uncontaminated(docs, bench, block_windows=block)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    if block > 7:
        assert multiset(decontam.op10_wu_manber(docs, bench)) == want
        assert decontam.op10_wu_manber(none, bench).count() == 0
        assert not any(r.contaminated for r in decontam.op10_wu_manber(docs, bench.limit(0)).collect())


def test_many_items_of_one_window(spark):
    window = [f"w{i}" for i in range(10)]
    items = [(f"i{k:06}", tuple(w.encode() for w in window)) for k in range(100_000)]
    began = time.monotonic()
    [searcher] = decontam.build(items + items[:5])
    assert time.monotonic() - began < 2
    found = list(searcher.scan([w.encode() for w in ["x", *window, *window]]))
    assert [at for at, _ in found] == [1, 11] and list(found[0][1]) == [i for i, _ in items]
    docs = spark.createDataFrame([(1, " ".join(window * 300))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(window)) for k in range(3000)], "item_id string, text string")
    [r] = decontam.op10_wu_manber(docs, bench).collect()
    assert (r.n_hit, r.n_items) == (3000, 3000)


def test_tables_are_built_once_a_task(monkeypatch):
    """The function of a task builds when it is made, not when rows come."""
    import pyarrow as pa

    built = []
    real = decontam.build
    monkeypatch.setattr(decontam, "build", lambda items: built.append(len(items)) or real(items))
    made = {}
    monkeypatch.setattr(decontam, "map_rows", lambda df, make, out: made.setdefault("make", make))
    monkeypatch.setattr(decontam, "schema_of", lambda *a, **k: None)

    class Sent:
        value = [("1", (b"a", b"b")), ("2", (b"c",))]

    decontam.searched(None, Sent(), keep=[], read="t")
    fn = made["make"]()
    for _ in range(5):
        out = fn(pa.record_batch({"t": ["x a b c", None]}))
    assert built == [2] and out["item_ids"] == [["1", "2"], []]


# --- columns that are kept


def test_kept_columns_have_other_names_than_those_that_are_made(docs):
    pages = docs.withColumnRenamed("text", "html").withColumn("text", docs["lang"])
    for make in (
        lambda: html_extract.extracted(pages, keep=["text"]),
        lambda: license_scan.license_notices(docs, keep=["doc_id", "n_words"]),
        lambda: pii.personal_data(docs.withColumn("spans", docs["lang"]), keep=["spans"]),
        lambda: packing.packed(docs, keep=["start"]),
        lambda: simhash.fingerprints(docs, keep=["fp"]),
        lambda: decontam.contamination(docs, docs.select("doc_id", "text"), keep=["n_words"], item_col="doc_id"),
    ):
        with pytest.raises(ValueError, match="rename them first"):
            make()


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [row(i, prose(rng, rng.randint(40, 200)).replace("\n", ""), "en", f"s{i % 12}") for i in range(150)]
    rows += [row(500 + i, rows[i][1], "en", "s1") for i in range(5)]
    rows += [row(600 + i, rows[20 + i][1] + "\n" + "the line that all sites share is this one", "en", f"s{i}") for i in range(12)]
    rows += [row(700, "too short"), row(701, None), row(702, prose(rng, 50).replace("\n", "") + " LEAK the passage of ten words that a benchmark item has inside it")]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "leak the passage of ten words that a benchmark item has")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(150)) <= set(kept) and not set(kept) & {500, 501, 502, 503, 504, 700, 701, 702}
    assert "share" not in kept.get(605, "")
    before = written_tables(spark)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept)
    new = {p.rsplit("-", 1)[0] for p in written_tables(spark) - before}
    assert {p for p in new if "stage-" in p} == {"tidemark-stage-decontamination"} and len(new) <= 3


def written_tables(spark):
    """Names of the tables that are there now."""
    folder = Path(tables.shared_dir(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir() if p.name.startswith("tidemark")}
