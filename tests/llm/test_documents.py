"""Near copies, repeats, benchmark passages, shards, fingerprints and toxicity against brute force and fixtures."""

import base64
import bisect
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from plinth.llm import common, decontaminate, fingerprint, hashing, minhash, queries, repeats, sharding, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies, shared passages and every awkward row."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(40, 160)) for _ in range(25)]
    rows = list(enumerate(base, 100))
    rows += [(200 + k, base[k % 4]) for k in range(12)]
    for k in range(40):
        words = base[5].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((300 + k, " ".join(words)))
    passage = prose(rng, 40)
    rows += [(400 + k, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 15)) for k in range(6)]
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "ONE two  three"), (6, "é" * 130), (7, "é" * 130), (8, "abc" * 4000), (9, passage * 60), (10, passage * 60), (10, passage * 60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in corpus], "doc_id long, text string, lang string, component string, _id string").repartition(5)


# ---- near copies -----------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute_components(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j in range(len(sets)):
        for i in range(j):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) or sets[i][0] == sets[j][0]:
                parent[root(j)] = root(i)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(docs, corpus, percent):
    assert sorted(map(tuple, minhash.near_duplicates(docs, percent).collect())) == brute_components(corpus, percent)


def test_near_duplicates_in_small_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(minhash, "STAR_MEMBERS", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 85).collect())) == brute_components(corpus, 85)


def test_near_duplicates_by_hot_lists(docs, corpus, monkeypatch):
    for name, value in (("HOT_KEYS", 3), ("HOT_ROWS", 2)):
        monkeypatch.setattr(common, name, value)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 85).collect())) == brute_components(corpus, 85)


def test_near_duplicates_without_a_common_original(spark, monkeypatch):
    """Copies of copies: no leader is near all, so components grow along chains, over small and large ones."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(minhash, "STAR_MEMBERS", 3)
    rng = random.Random(3)
    rows, base = [], prose(rng, 80).split()
    for k in range(60):
        rows.append((rng.randrange(10**6), " ".join(base)))
        for _ in range(rng.choice([1, 1, 2, 4])):
            base[rng.randrange(len(base))] = prose(rng, 1)
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(shuffled, 85).collect())) == brute_components(rows, 85)


def test_a_group_of_near_copies_costs_as_many_comparisons(spark):
    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 10_000):
        words = list(base)
        words[rng.randrange(100)] = f"edit{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    signed = minhash._signed(docs)
    classes = common.cut(signed.selectExpr("key", "doc_id AS node", "n_shingles", "signature"), "classes")
    prefix, leads = minhash._prefixes(classes, minhash.least_matches(85))
    assert prefix.join(leads, "post").where("node != a").select("a", "node").distinct().count() < 5 * len(rows)
    found = minhash.near_duplicates(docs, 85)
    assert {r.component_id for r in found.collect()} == {0}


def test_near_duplicates_of_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == [(3, 3, True), (None, None, True), (None, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_dedup_keeps_columns(docs, corpus):
    kept = minhash.dedup(docs, 80)
    assert kept.columns == docs.columns
    want = [i for i, _, _, k in brute_components(corpus, 80) if k]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_enough_matches_are_near_certain():
    assert minhash.least_matches(80) < minhash.least_matches(85) < 0.85 * minhash.COORDINATES
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        assert (rng.binomial(minhash.COORDINATES, percent / 100, 2_000_000) < minhash.least_matches(percent)).sum() == 0


# ---- repeated passages -----------------------------------------------------------------------------------------------


def brute_repeats(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(dict.fromkeys(rows), key=lambda r: r[0]):
        data = (t or "").encode()
        hit = bytearray(len(data))
        for k in range(len(data) - window + 1):
            s = data[k : k + window]
            if s in seen:
                hit[k : k + window] = b"\1" * window
            seen.add(s)
        runs = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        out[i] = (len(data), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(data, hit) if not h)).hexdigest())
    return sorted((i, *out[i]) for i, _ in rows)


def test_repeats_equal_brute_force(docs, corpus):
    assert sorted(map(tuple, repeats.digests(docs).collect())) == brute_repeats(corpus)


def test_repeats_in_shares_segments_and_portions(docs, corpus, monkeypatch):
    for name, value in (("SHARE", 3), ("SEGMENT_BYTES", 500), ("GROUP_BYTES", 700), ("SETTLED", 50)):
        monkeypatch.setattr(repeats, name, value)
    assert sorted(map(tuple, repeats.digests(docs).collect())) == brute_repeats(corpus)


def test_repeats_by_hot_phrases(docs, corpus, monkeypatch):
    for module, name, value in ((repeats, "SHARE", 3), (common, "HOT_KEYS", 5), (common, "HOT_ROWS", 2)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, repeats.digests(docs).collect())) == brute_repeats(corpus)


@pytest.mark.parametrize("window", [1, 3, 8, 13, 100])
def test_suffix_classes_are_alphabetical(window):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:350] = data[:150]
    strings = [data[i : i + window].tobytes() for i in range(len(data) - window + 1)]
    place = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert repeats.suffix_classes(data, window).tolist() == [place[x] for x in strings]
    assert len(repeats.suffix_classes(data[: window - 1], window)) == 0


def test_repeats_beside_clashing_columns(spark, corpus):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in corpus], "doc_id long, text string, _spans string, spans string")
    out = repeats.without(df)
    assert out.columns == df.columns and {(r._spans, r.spans) for r in out.collect()} == {("a", "b")}


def test_repeats_of_a_text_in_many_segments(spark):
    """Each segment is a group of its own; the earliest place of the earliest document stays."""
    rng = random.Random(21)
    passages = [prose(rng, 60) for _ in range(3)]
    long = " ".join(prose(rng, 50) + " " + passages[k % 3] for k in range(24))
    rows = [(1, long), (2, prose(rng, 30) + passages[0]), (0, prose(rng, 30)), (3, long[5000:9000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, repeats.digests(df, segment=700, group=1).collect())) == brute_repeats(rows)


def test_texts_without_repeats(spark, docs, corpus):
    out = repeats.without(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[7] == "" and got[1] is None and got[4] == "one two three"
    assert got[100] == dict(corpus)[100]
    assert repeats.digests(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x" * 50 + "y" * 80), (5, "y" * 20 + "x" * 50 + "y" * 80)], "doc_id long, text string")
    assert sorted((r.n_removed for r in repeats.digests(nulls).collect())) == [0, 130]


# ---- benchmark passages ----------------------------------------------------------------------------------------------


def brute_matches(rows, items, threshold=0.8):
    index = decontaminate.Index(items)
    out = set()
    for i, t in rows:
        own = decontaminate.chains(minhash.word_hashes([t or ""])[0], 5)
        for item, s in zip(index.ids, index.shingles):
            width = min(len(s), len(own))
            if width and max(decontaminate.similarity(own[k : k + width], s, index.weight) for k in range(len(own) - width + 1)) >= threshold:
                out.add((i, item))
        words = (t or "").encode().lower().split()
        for item, text in items:
            w = text.encode().lower().split()
            if 0 < len(w) < 5 and any(words[k : k + len(w)] == w for k in range(len(words) - len(w) + 1)):
                out.add((i, item))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(30)] + [(90, "just three words"), (91, ""), (92, "THREE Words")]
    rows = []
    for k in range(60):
        words = items[k % 30][1].split()
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, prose(rng, 30) + "\n" + " ".join(words) + " " + prose(rng, 10)))
    rows += [(100, prose(rng, 500)), (101, items[3][1].upper()), (102, "a just three words b"), (103, None), (104, ""), (105, " ".join(items[4][1].split()[:-2])), (106, items[7][1] + " " + items[8][1])]
    return rows, items


def test_matches_equal_brute_force(spark, leaks, monkeypatch):
    rows, items = leaks
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (93, None)], "item_id long, text string")
    want = brute_matches(rows, items)
    assert {(k, k) for k in range(0, 30, 3)} <= want and (106, 7) in want and (102, 90) in want
    got = decontaminate.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity == 1.0 for r in got if r.doc_id in (0, 3, 101, 106))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 10)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == want
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 == decontaminate.matches(docs.limit(0), bench).count()
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_weights_do_not_depend_on_the_passes(spark, monkeypatch):
    """Templated and repeated items, each edited in one word: equal rows whether the items are in one pass or in many."""
    rng = random.Random(31)
    frame = prose(rng, 40)
    items = [(k, frame + " " + prose(rng, 12)) for k in range(8)] + [(20 + k, prose(rng, 50)) for k in range(4)]
    items += [(30 + k, items[8][1]) for k in range(5)]
    rows = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        words[25] = "changed"
        rows.append((k, prose(rng, 20) + " " + " ".join(words) + " " + prose(rng, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.Index(items)
    assert set(index.weight(index.shingles[8]).tolist()) == {decontaminate.HEAVIEST}  # copies of an item count once
    assert set(index.weight(index.shingles[0][:36]).tolist()) == {1}
    whole = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    assert {(8, 20 + 10 * j) for j in (0, 1)} <= {(d, i) for d, i, *_ in whole}
    for size in (1, 3):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", size)
        assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == whole
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {r[0] for r in rows} - {w[0] for w in whole}


def test_uneven_weights_lose_no_match(spark):
    """Templates with one own word, items of repeated words, and leaks edited by heavy or repeated shingles."""
    rng = random.Random(41)
    frame, other = prose(rng, 100), prose(rng, 47)
    items = [(k, frame + " own" + str(k)) for k in range(8)]
    items += [(20, other), (21, "la " * 30 + prose(rng, 8)), (22, prose(rng, 20) + " tra la" * 12), (23, frame)]
    rows = [(k, prose(rng, 25) + " " + frame + " edit" + str(k) + " " + prose(rng, 30)) for k in range(12)]
    words = other.split()
    rows += [(30 + k, prose(rng, 9) + " " + " ".join(words[:-5] + ["w" + str(k)] * 5) + " " + " ".join(["w" + str(k)] * 9)) for k in range(12)]
    rows += [(50, "la " * 200), (51, items[9][1]), (52, prose(rng, 40) + " " + items[10][1] + " tra la" * 30), (53, " ".join(frame.split()[:90])), (54, frame)]
    rows += [(60, prose(rng, 300)), (61, " ".join([*frame.split()[:50], "new", *frame.split()[51:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_matches(rows, items) >= {(d, i) for d in range(12) for i in range(8)}
    index, texts = decontaminate.Index(items), dict(rows)
    for r in got:
        own = decontaminate.chains(minhash.word_hashes([texts[r.doc_id]])[0], 5)
        s = index.shingles[index.ids.index(r.item_id)]
        width = min(len(s), len(own))
        scores = [decontaminate.similarity(own[k : k + width], s, index.weight) for k in range(len(own) - width + 1)]
        assert r.similarity == max(scores) and r.first_word == scores.index(max(scores))


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.Index([(k, prose(random.Random(k), 30)) for k in range(20)])
    for item in range(20):
        for flips in (0, 5, decontaminate.RADIUS, decontaminate.RADIUS + 1):
            bits = np.unpackbits(index.blocks[item].view(np.uint8))
            bits[rng.choice(128, flips, replace=False)] ^= 1
            _, found = index.near(np.packbits(bits).view(np.uint16)[None], np.zeros(1, int))
            assert (item in found) == (flips <= decontaminate.RADIUS)


# ---- shards ----------------------------------------------------------------------------------------------------------


def test_shards(docs, corpus):
    rows = sharding.shard(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and {r.law for r in rows} == {"rows"}


def spark_hash(*values):
    """Spark's xxhash64 of longs: each seeds the next, nulls pass the seed on."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def brute_ring(rows, shards, virtual_nodes=64, bits=14):
    """A plain ring: each row goes to the next virtual node clockwise; rows that find it full walk on, one at a time."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> 64 - bits, s) for s in range(shards) for v in range(virtual_nodes))
    marks = [n[0] for n in nodes]
    keys = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    keys.sort(key=lambda k: (spark_hash(k[0]) >> 64 - bits, spark_hash(*k), k[1:]))
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, over = [], []
    for k in keys:
        node = bisect.bisect_left(marks, spark_hash(k[0]) >> 64 - bits) % len(nodes)
        home = nodes[node][1]
        if room[home]:
            room[home] -= 1
            out.append((*k, home, home))
        else:
            over.append((k, node))
    for k, node in over:
        home = nodes[node][1]
        while not room[nodes[node % len(nodes)][1]]:
            node += 1
        room[nodes[node % len(nodes)][1]] -= 1
        out.append((*k, nodes[node % len(nodes)][1], home))
    return sorted(out, key=repr)


def ring_rows(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.home_shard) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards", [3, 16])
def test_shards_equal_a_plain_ring(docs, corpus, shards):
    assert ring_rows(sharding.shard(docs, shards)) == brute_ring(corpus, shards)


def test_shards_of_hot_places_equal_a_plain_ring(spark, monkeypatch):
    """A doc_id, null and a whole row that many rows share, ranked in several cells and dealt out in several portions."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(7, f"text {k}") for k in range(300)] + [(None, f"text {k}") for k in range(200)] + [(5, "same")] * 250 + [(None, None)] * 40 + [(k, "own") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df)
    assert ring_rows(got) == brute_ring(rows, 16)
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_of_one_hot_place_and_of_nothing(spark):
    same = spark.createDataFrame([(7, "x")] * 100 + [(None, None)] * 3, "doc_id long, text string")
    counts = {}
    for r in sharding.shard(same).collect():
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert sorted(counts.values()) == [6] * 9 + [7] * 7
    assert sharding.shard(same.limit(0)).count() == 0


def test_few_rows_move_when_a_shard_is_added():
    """1 / 17 of the rows must move; overflow and its walk clockwise add some."""
    nodes = {s: sharding.ring(s) for s in (16, 17)}
    counts = {a: 3 for a in range(1 << sharding.ARC_BITS)}
    where = {s: {} for s in nodes}
    for s, ring in nodes.items():
        for arc, low, high, _, shard, _ in sharding.allot(counts, ring, s):
            where[s].update({(arc, k): shard for k in range(low, high)})
    moved = [k for k in where[16] if where[16][k] != where[17][k]]
    assert 1 / 17 <= len(moved) / len(where[16]) + 1e-4 < 0.09
    assert sum(where[17][k] != 16 for k in moved) / len(where[16]) < 0.03


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def naive_chunks(text):
    """Chunks of a text as byte strings: the gear hash byte by byte."""
    data, out, begin, gear = text.encode(), [], 0, 0
    for at, byte in enumerate(data):
        gear = (2 * gear + int(fingerprint._GEAR[byte])) % 2**32
        size = at + 1 - begin
        bits = fingerprint.STRICT_BITS if size < fingerprint.NORMAL_BYTES else fingerprint.LOOSE_BITS
        if size >= fingerprint.MIN_BYTES and (gear >> 32 - bits == 0 or size == fingerprint.MAX_BYTES):
            out.append(data[begin : at + 1])
            begin = at + 1
    return [*out, data[begin:]] if begin < len(data) else out


def naive_mark(chunk):
    """48 bits of a polynomial hash of a chunk and 16 of its length."""
    total = sum(int(hashing.TABLES[0][b]) * pow(hashing._ODD[0], k, 2**64) for k, b in enumerate(chunk)) % 2**64
    return int(hashing.mix(np.array([total], np.uint64))[0]) >> 16 << 16 | len(chunk)


def naive_likeness(a, b):
    """The share of the length of the different chunks of a that are also chunks of b."""
    a, b = set(a), set(b)
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def test_fingerprints_equal_brute_force(docs, corpus):
    rows = sorted(corpus, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for (i, t), (_, u) in zip(rows, [*rows[1:], rows[0]]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        f, g, h = map(naive_chunks, (t, e, u))
        written = (base64.b64encode(np.array(sorted(set(map(naive_mark, c))), "<u8").tobytes()).decode() for c in (f, g))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *written, naive_likeness(f, g), naive_likeness(f, h)))
    assert sorted(map(tuple, fingerprint.compare(docs).collect())) == sorted(want)


def test_fingerprint_cases(spark):
    df = spark.createDataFrame([(1, "solo text")], "doc_id long, text string")
    assert fingerprint.compare(df).first().near_next == 1.0
    assert fingerprint.compare(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None), (None, "a"), (2, "")], "doc_id long, text string")
    assert fingerprint.compare(none).count() == 3


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(3)
    text = prose(rng, 3000)
    data = np.frombuffer(text.encode(), np.uint8)
    starts, stops = fingerprint.cuts(data, np.array([len(data)]))
    assert starts[0] == 0 and stops[-1] == len(data) and (starts[1:] == stops[:-1]).all()
    size = stops - starts
    assert size.max() <= fingerprint.MAX_BYTES and size[:-1].min() >= fingerprint.MIN_BYTES and 50 < size.mean() < 90
    a, b = fingerprint.chunk_sets([text, "shifted by a few words " + text])
    assert fingerprint.likeness(a, b) > 0.97 and fingerprint.likeness(*fingerprint.chunk_sets([text, prose(rng, 3000)])) < 0.05
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()


# ---- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 8 == 0
        words = prose(rng, 60).split()
        if toxic:
            words[5:5] = [rng.choice(["grumbleft", "grumbledo", "snarkolax", "vexoblat"]) + rng.choice(["", "ix", "or"]) for _ in range(3)]
        rows.append((k, " ".join(words), "x"))
        labels.append((k, 1, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "null id", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (9000, 9001))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)


def test_held_out_labels_are_never_learnt(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).collect()), key=repr) for x in (labels, flipped))
    assert one == two


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.limit(0))
    assert model.voters == [] and np.allclose(model.scores(["a fine day", "", "x" * 300_000]), toxicity.CLEAN)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.keep_clean(docs, model).count() == docs.count()


def brute_votes(texts, voters):
    out = set()
    for i, text in enumerate(texts):
        words = re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())
        shown = {"/" + name for name, p in toxicity.PATTERNS.items() if re.search(p, text)} | ({"/repeating"} if any(len(set(words[k : k + 3])) == 1 for k in range(len(words) - 2)) else set())
        out |= {(i, j) for j, (stem, least) in enumerate(voters) if stem in shown or sum(w.startswith(stem) for w in words) >= least}
    return out


def test_votes_equal_brute_force(corpus):
    voters = [("alph", 2), ("alpha1", 1), ("beta", 12), ("éééé", 1), ("epsi", 1), ("gamm", 3), ("/repeating", 1), ("/shouting", 1), ("nothing", 1)]
    texts = [t or "" for _, t in corpus] + ["go go go", "ALPHA1 alpha2!!", "alpha1" * 50_000, "x " * 100_000 + "alpha11"]
    model = toxicity.Model(voters, np.zeros(len(voters) + 3))
    text, voter, totals = model.votes(texts)
    assert set(zip(text.tolist(), voter.tolist())) == brute_votes(texts, voters) and len(totals) == len(texts)
    assert np.allclose(np.expm1(totals[:, 0]), [sum(i == k for i, _ in brute_votes(texts, voters)) for k in range(len(texts))])


def independent(rng, n=3000, share=0.3):
    y = rng.random(n) < share
    return y, np.stack([np.where(y, rng.random(n) < on, rng.random(n) < off) for on, off in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.03), (0.5, 0.02))], 1).astype(float)


def test_label_model_recovers_rates():
    y, votes = independent(np.random.default_rng(4))
    post, model = toxicity.label_model(votes, y.astype(float))
    clear = votes.sum(1) != 1  # abstaining says nothing, so one stray vote (8 % of the clean rows) counts
    assert ((post > 0.5) == y)[clear].mean() > 0.97
    for j, (on, off) in enumerate(((0.8, 0.02), (0.6, 0.05), (0.7, 0.03), (0.5, 0.02))):
        assert on - 0.25 < model.together[1, j] < on + 0.05 and model.together[0, j] < off + 0.05  # strays thin the toxic side out


def test_label_model_counts_voters_that_repeat_each_other_once():
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    one = np.where(y, rng.random(3000) < 0.8, rng.random(3000) < 0.2)
    other = np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.2)
    votes = np.stack([one, one, one, other], 1).astype(float)
    _, model = toxicity.label_model(votes, y.astype(float))
    _, plain = toxicity.label_model(votes[:, [0, 3]], y.astype(float))
    assert (model.correlation > 0.1).sum() == 2  # the copies hang on the first
    assert abs(model.posterior(np.array([[1.0, 1, 1, 0]]))[0] - plain.posterior(np.array([[1.0, 0]]))[0]) < 0.05


def test_voters_that_agree_overrule_gold():
    y, votes = independent(np.random.default_rng(6))
    wrong = np.flatnonzero(y & (votes.sum(1) >= 3))[:40]
    gold = y.astype(float)
    gold[wrong] = 0
    quiet = np.flatnonzero(~y & (votes.sum(1) == 0))[:40]
    gold[quiet] = 1
    post, _ = toxicity.label_model(votes, gold)
    assert (post[wrong] > 0.5).all() and (post[quiet] < 0.5).all()


def test_lone_voters_keep_their_say_in_a_sample_rich_in_toxic_rows():
    """Voters that never speak together, half of the rows toxic, one in ten in the corpus."""
    votes = np.repeat(np.eye(4), 300, axis=0)
    votes = np.vstack([votes, np.zeros((1200, 4))])
    gold = np.repeat([1.0, 0.0], 1200)
    post, _ = toxicity.label_model(votes, gold, 0.1)
    assert (post[:1200] > 0.9).all() and (post[1200:] < 0.5).all()


def test_levels_and_telling():
    assert list(toxicity.levels(13)) == [1, 2, 3, 4, 6, 8, 12] and list(toxicity.levels(1)) == [1]
    counts = {("bad", 1): (90, 200), ("badly", 1): (50, 2), ("badly", 2): (45, 0), ("badlyx", 2): (15, 0), ("good", 1): (10, 900), ("rare", 1): (2, 0)}
    assert toxicity.telling(counts, 100, 1000) == [("badly", 1), ("bad", 1)]  # one count a beginning; badlyx is idle beside badly


# ---- queries ---------------------------------------------------------------------------------------------------------


def test_queries_over_whole_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).collect()]
    assert sorted(map(tuple, queries.op4_minhash_near_duplicates(spark, sf_dir).collect())) == brute_components(rows, 85)
    assert sorted(map(tuple, queries.op9_repeated_passages(spark, sf_dir).collect())) == brute_repeats(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op5_simhash_decontamination(spark, sf_dir).collect()} == brute_matches(rows, items)
    shards = queries.op7_bounded_ring_shards(spark, sf_dir)
    assert shards.count() == len(rows) and {r.grown_shard for r in shards.collect()} == {None}
    assert queries.op8_chunk_fingerprints(spark, sf_dir).count() == len(rows)
