import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import common, packing, queries, sstable, tokens

AWKWARD = [
    (5, "plain words, and marks!"), (1, None), (3, ""), (4, "  two  spaces\n\nlines \n end "), (2, "tab\tnbsp thin x\x1cy"), (9, "x" * 5000), (7, "word " * 9000),
    (8, "plain words, and marks!"), (8, "plain words, and marks!"), (None, "no id"), (-6, "été naïve ß 漢字 🙂 it's we're 123abc"), (12, "<|endoftext|> is text"),
]


@pytest.fixture(scope="module")
def library():
    return tokens.Encoder.of(tokens.tokenizer_path()).library


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in AWKWARD], "doc_id long, text string, start string, length long")


@cache
def _fresh(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab C.,'!\n\t  é漢1\r\x1c"), max_size=60))
def test_remembered_ids_equal_the_librarys(text):
    encoder = tokens.Encoder.of(tokens.tokenizer_path())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "a", "Bc", " ", "\n", ".", "é", "<|"]), max_size=20).map("".join))
def test_ids_equal_a_fresh_librarys(text):
    """Literal special tokens too are those of the library as it is loaded."""
    path = tokens.tokenizer_path()
    fresh = _fresh(path)
    assert np.frombuffer(tokens.Encoder.of(path).encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_a_special_token_in_a_text_is_one_id():
    path = tokens.tokenizer_path()
    special = _fresh(path).token_to_id("<|endoftext|>")
    assert special is not None and np.frombuffer(tokens.Encoder.of(path).encode("a <|endoftext|> b"), "<u4").tolist().count(special) == 1


def expected_rows(library, rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, t)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_sstable_round_trip(spark, library, awkward):
    from pyspark.sql import functions as F

    manifest = sstable.write_shards(awkward, common.scratch(spark, "test-sst"))
    got = sstable.read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_rows(library, AWKWARD)
    assert sum(m["keys"] for m in manifest) == len(AWKWARD)


def test_sstable_lookup(spark, library, awkward):
    manifest = sstable.write_shards(awkward, common.scratch(spark, "test-sst"))
    found = {}
    for m in manifest:
        reader = sstable.Reader(m["path"])
        for doc_id, _ in AWKWARD:
            ids = reader.get(sstable.key_of(doc_id))
            if ids is not None:
                found[doc_id] = ids.tolist()
        assert reader.get(sstable.key_of(10**15)) is None
    assert found == {i: ids_of(library, t) for i, t in AWKWARD}


def test_sstable_blocks_and_filter(tmp_path):
    path = str(tmp_path / "a.sst")
    with common.published(path) as out:
        writer = sstable.Writer(out, 4)
        for k in range(-3000, 3000):
            writer.add(sstable.key_of(k), np.arange(k % 50, dtype=np.uint32))
        writer.close()
    reader = sstable.Reader(path)
    assert len(reader.index) > 3 and reader.keys == 6000
    assert [sstable.id_of(k) for k, _ in reader] == list(range(-3000, 3000))
    assert all(reader.get(sstable.key_of(k)).tolist() == list(range(k % 50)) for k in range(-3000, 3000, 97))
    wrong = sum(reader.may_hold(sstable.key_of(k)) for k in range(10_000, 20_000))
    assert wrong < 300


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    assert sstable.read_shards(spark, sstable.write_shards(none, common.scratch(spark, "test-sst"))).count() == 0
    assert packing.pack(none).count() == 0


def check_packing(library, rows, placed, capacity):
    docs = Counter((i, t or "") for i, t in rows)
    seen = Counter()
    by_bin = {}
    for r in placed:
        by_bin.setdefault(r.sequence_id, []).append(r)
        seen[r.doc_id] += r.length
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
    want = Counter()
    for (i, t), n in docs.items():
        want[i] += n * len(ids_of(library, t))
    assert seen == want
    return len(by_bin)


def test_packing_places_every_piece(library, awkward):
    placed = packing.pack(awkward).collect()
    check_packing(library, AWKWARD, placed, packing.CAPACITY)
    long = sorted((r for r in placed if r.doc_id == 7), key=lambda r: r.piece)
    ids = ids_of(library, dict(AWKWARD)[7])
    assert [r.length for r in long] == [len(ids) % 2048 or 2048] + [2048] * (len(long) - 1)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in long]).tolist() == ids
    assert [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1]]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_use_every_length_once(histogram):
    used = Counter()
    for lengths, times in packing.patterns(histogram, 64):
        assert sum(lengths) <= 64
        used.update({x: n * times for x, n in Counter(lengths).items()})
    assert used == Counter(histogram)


def test_two_fit_beats_greedy():
    """Greedy fills 60 with 33 and 20; the 20 gives way to 14 and 13, which fill the gap."""
    assert packing.patterns({33: 1, 20: 1, 14: 1, 13: 1}, 60)[0] == ([33, 14, 13], 1)


def test_packing_is_close_to_the_bound(spark, sf_dir):
    placed = packing.pack(common.documents(spark, sf_dir)).collect()
    bins = len({r.sequence_id for r in placed})
    assert bins <= -(-sum(r.length for r in placed) // 2048) * 1.02 + 1


def test_queries(spark, library, sf_dir):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).collect()]
    got = sorted(map(tuple, queries.op1_token_sstable(spark, sf_dir).collect()))
    assert got == sorted(expected_rows(library, docs))
    crc = {}
    for i, t in docs:
        ids = ids_of(library, t)
        head = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(head, len(ids), 2048)]):
            part = ids[start : start + (2048 if piece else head)]
            crc[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op2_best_two_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == crc and len(rows) == len(crc)
