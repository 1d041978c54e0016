"""Repeated passages over a whole corpus, by prefix-free parsing.

A window is a string of WINDOW bytes within one text. Every window that also starts earlier in corpus order (smaller
doc_id, or the same text further left) is removed with all bytes it covers. As the parse of equal content is equal:

1. The parse cuts texts into phrases, each named by a trigger (plinth.llm.phrases). Phrases whose trigger occurs once
   hold no repeated window; a count over triggers leaves the rest. Each input partition settles what repeats within it and
   asks about each trigger once, so no trigger is frequent in the shuffle.
2. The parse's suffixes in order: a phrase holds its windows whole, so an order of the parse by phrase, then by document
   and place, is deep enough. The first of each phrase is its entry in the dictionary; every other one is a repeat as a whole.
3. The suffix array of the dictionary: suffixes of its phrases, compared byte by byte up to WINDOW bytes (prefix doubling),
   give classes of equal windows in alphabetical order.
4. Both together give corpus order: within a class suffixes stand in the order of their phrases' first places in the
   parse, and all but the first are repeats. Only phrases of one trigger can share a window, so the dictionary is dealt by
   trigger. A trigger with many phrases is dealt out in shares of SHARE phrases; the suffixes that are first in their share
   are then ordered over all shares.

Phrases (at most 176 bytes), and windows of different shares, are the same if two independent 64-bit hashes of their bytes
agree; within a share bytes are compared.

Defined cases: null text is empty; texts shorter than the window lose nothing; a null doc_id comes before all others;
of different texts with equal doc_ids the order is that of their hashes; rows equal in doc_id and text are one document
and get equal results; very long texts are parsed in overlapping segments, with the same result; an empty table gives
no rows; extra columns are kept by attach() and without().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import common, hashing
from plinth.llm.phrases import Phrases

WINDOW = 100
SHARE = 512
BUCKETS = 4096
SEGMENT_BYTES = 1 << 20
GROUP_BYTES = 1 << 20
#: Phrases settled together in step 1.
SETTLED = 400_000
_LOWEST = -(1 << 63)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """_id (doc_id, null lowest) and _dk (hash of doc_id and text) name a document."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("_id"), F.xxhash64("doc_id", text).alias("_dk"), text.alias("_text"), *more)


def _parsed(batch: pa.RecordBatch, window: int, segment: int, group: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """Phrases of a batch, a group of texts of about `group` bytes at a time, longer texts in segments: with the row and
    the offset in its text of each laid-out piece."""
    rows, offsets, raw, held = [], [], [], 0
    for row, text in enumerate(common.column(batch, "_text")):
        data = text.encode()
        for offset in range(0, max(1, len(data)), segment):
            piece = data[offset : offset + segment + window - 1]
            if offset and len(piece) < window:
                continue
            rows.append(row)
            offsets.append(offset)
            raw.append(piece)
            held += len(piece)
            if held > group:
                yield Phrases(raw, window), np.array(rows), np.array(offsets)
                rows, offsets, raw, held = [], [], [], 0
    if raw:
        yield Phrases(raw, window), np.array(rows), np.array(offsets)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _repeated_triggers(docs: DataFrame, window: int, segment: int, group: int) -> DataFrame:
    """_dk, places: the phrases of each document whose trigger occurs more than once. (Documents with equal hashes share
    their places, which only names more phrases than need be.)"""

    def ask(batches):
        """key, _dk, mark: mark is 4 times the place, and 0 for a trigger that is once in this portion, 1 for the first
        of several, 2 for another of them, which needs no answer and so gets a key of its own."""
        held, size = [], 0

        def portion():
            key, dks, at = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, dks, at = key[order], dks[order], at[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            again = np.concatenate([~fresh[1:], [False]])
            key = np.where(fresh, key, hashing.pair_hash(dks.view(np.uint64), at.astype(np.uint64)))
            mark = at * 4 + np.where(fresh, again, 2)
            for i in range(0, len(key), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([_signed(key[j]), pa.array(dks[j]), pa.array(mark[j])], ["key", "_dk", "mark"])

        for batch in batches:
            dk = _longs(batch, "_dk")
            for p, rows, offsets in _parsed(batch, window, segment, group):
                if len(p.first):
                    held.append((p.trigger, dk[rows[p.text]], p.first - p.starts[p.text] + offsets[p.text]))
                    size += len(p.first)
            if size > SETTLED:
                yield from portion()
                held, size = [], 0
        if held:
            yield from portion()

    def answer(batches):
        held = None

        def settle(key, dk, mark):
            flag = mark & 3
            asks = flag < 2
            own = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
            many = np.bincount(own, asks + 2 * (flag == 1)) > 1
            yes = ~asks | many[own]
            return pa.RecordBatch.from_arrays([pa.array(dk[yes]), pa.array((mark[yes] >> 2).astype(np.int32))], ["_dk", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [_longs(batch, n) for n in ("key", "_dk", "mark")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))  # keys come in order
            held = [x[last:] for x in now]
            if last:
                yield settle(*(x[:last] for x in now))
        if held is not None:
            yield settle(*held)

    asked = keyed(docs).select("_dk", "_text").mapInArrow(common.tidy(ask), "key long, _dk long, mark long")
    dealt = asked.repartition(common.partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(common.tidy(answer), "_dk long, at int").groupBy("_dk").agg(F.collect_list("at").alias("places"))


def _picked(batch: pa.RecordBatch, window: int, segment: int, group: int, column: str) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases named by the sorted places in a list column: parse, their numbers, rows, places, positions in the list."""
    lists = [np.array(x, np.int64) for x in common.column(batch, column)]
    size = max((int(x.max()) for x in lists if len(x)), default=0) + 1
    named = np.concatenate([x + row * size for row, x in enumerate(lists)]) if lists else np.zeros(0, np.int64)
    order = np.argsort(named, kind="stable")
    named = named[order]
    for p, rows, offsets in _parsed(batch, window, segment, group):
        if not len(p.first) or not len(named):
            continue
        row, at = rows[p.text], p.first - p.starts[p.text] + offsets[p.text]
        code = np.where(at < size, row * size + at, -1)
        k = np.minimum(np.searchsorted(named, code), len(named) - 1)
        own = np.flatnonzero(named[k] == code)
        yield p, own, row[own], at[own], order[k[own]]


def _occurrences(docs: DataFrame, places: DataFrame, window: int, segment: int, group: int) -> DataFrame:
    """e1, e2 (hash of the bytes), trigger, _id, _dk, at, windows of the phrases in places; again
    is set where the same bytes stand further left in the same group of the same document."""

    def run(batches):
        for batch in batches:
            id_, dk = _longs(batch, "_id"), _longs(batch, "_dk")
            for p, own, row, at, _ in _picked(batch, window, segment, group, "places"):
                start = p.first[own]
                end = start + p.windows[own] + window - 1
                e1, e2 = p.ranges.of(start, end), hashing.Ranges(p.data, 1).of(start, end)
                again = _later((e1, e2, row), at)
                yield pa.RecordBatch.from_arrays(
                    [_signed(e1), _signed(e2), _signed(p.trigger[own]), pa.array(id_[row]), pa.array(dk[row]), pa.array(at.astype(np.int32)), pa.array(p.windows[own].astype(np.int32)), pa.array(again)],
                    ["e1", "e2", "trigger", "_id", "_dk", "at", "windows", "again"],
                )

    return keyed(docs).join(places, "_dk").mapInArrow(common.tidy(run), "e1 long, e2 long, trigger long, _id long, _dk long, at int, windows int, again boolean")


def _contexts(docs: DataFrame, chosen: DataFrame, window: int, segment: int, group: int) -> DataFrame:
    """trigger, shares, share, _id, _dk, at, bytes of the dictionary phrases in chosen (_id, _high, places, shares, share)."""

    def run(batches):
        out = pa.schema([("trigger", pa.int64()), ("shares", pa.int32()), ("share", pa.int32()), ("_id", pa.int64()), ("_dk", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            id_, dk = _longs(batch, "_id"), _longs(batch, "_dk")
            shares, share = (np.array([x for xs in common.column(batch, n) for x in xs], np.int32) for n in ("shares", "share"))
            for p, own, row, at, k in _picked(batch, window, segment, group, "places"):
                raw = p.data.tobytes()
                got = [raw[a:b] for a, b in zip(p.first[own].tolist(), (p.first[own] + p.windows[own] + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays([_signed(p.trigger[own]), pa.array(shares[k]), pa.array(share[k]), pa.array(id_[row]), pa.array(dk[row]), pa.array(at.astype(np.int32)), pa.array(got, pa.binary())], schema=out)

    return keyed(docs).withColumn("_high", F.shiftright("_dk", 32)).join(chosen, ["_id", "_high"]).mapInArrow(common.tidy(run), "trigger long, shares int, share int, _id long, _dk long, at int, bytes binary")


def _later(content: tuple[np.ndarray, ...], *place: np.ndarray) -> np.ndarray:
    """Of suffixes, those with equal content and an earlier place before them (place: most significant first)."""
    order = np.lexsort((*reversed(place), *content))
    later = np.zeros(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for c in content:
        same &= c[order[1:]] == c[order[:-1]]
    later[order[1:]] = same
    return later


def suffix_classes(data: np.ndarray, window: int) -> np.ndarray:
    """The rank of every string of `window` bytes among all of them, in alphabetical order; equal strings have equal ranks.
    By prefix doubling: ranks of strings of twice the length come from the ranks of their halves."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64)
    done = 8 if window >= 8 else 1
    key = np.zeros(n - done + 1, np.uint64)
    for k in range(done):
        key = key << np.uint64(8) | data[k : n - done + 1 + k]
    rank = np.unique(key, return_inverse=True)[1]
    while done < window:
        step = min(done, window - done)
        pair = rank[: len(rank) - step] * (n + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        done += step
    return rank


def _runs(id_: np.ndarray, dk: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Consecutive windows as covered spans: _id, _dk, start, end; windows sorted by document and place."""
    if not len(at):
        return [id_, dk, at, at]
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (dk[1:] != dk[:-1]) | (id_[1:] != id_[:-1])])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return [id_[first], dk[first], at[first], at[last] + window]


_ORDERED = "_id long, _dk long, s int, e int, trigger long, bucket int, suffixes binary"
_ORDERED_ARROW = pa.schema([("_id", pa.int64()), ("_dk", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("trigger", pa.int64()), ("bucket", pa.int32()), ("suffixes", pa.binary())])
_SUFFIX = np.dtype([("one", "<u8"), ("two", "<u8"), ("id", "<i8"), ("dk", "<i8"), ("at", "<i4")])


def _ordered(contexts: DataFrame, window: int) -> DataFrame:
    """Covered spans within shares, and packed first suffixes of triggers with several shares (_id null)."""

    def order(rows):
        trigger, shares, _, id_, dk, at, raw = (np.array(c) if k < 6 else c for k, c in enumerate(zip(*rows)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        count = size - window + 1
        row = np.repeat(np.arange(len(raw)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(size) - size)[row] + inner
        classes = suffix_classes(data, window)[start]
        rank = np.empty(len(raw), np.int64)
        rank[np.lexsort((at, dk, id_))] = np.arange(len(raw))
        later = _later((classes,), rank[row], inner)
        by_place = np.argsort(rank[row], kind="stable")
        dup = by_place[later[by_place]]
        spans = _runs(id_[row[dup]], dk[row[dup]], at[row[dup]] + inner[dup], window)
        none = len(spans[0])
        yield pa.RecordBatch.from_arrays([pa.array(spans[0]), pa.array(spans[1]), pa.array(spans[2].astype(np.int32)), pa.array(spans[3].astype(np.int32)), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=_ORDERED_ARROW)
        open_ = np.flatnonzero(~later & (shares[row] > 1))
        if len(open_):
            packed = np.zeros(len(open_), _SUFFIX)
            first = start[open_]
            packed["one"], packed["two"] = (hashing.Ranges(data, which).of(first, first + window) for which in (0, 1))
            packed["id"], packed["dk"], packed["at"] = id_[row[open_]], dk[row[open_]], at[row[open_]] + inner[open_]
            own = trigger[row[open_]]
            bucket = (packed["one"] >> np.uint64(32)).astype(np.int64) % np.minimum(shares[row[open_]], BUCKETS)
            by = np.lexsort((bucket, own))
            packed, own, bucket = packed[by], own[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
            parts = [x.tobytes() for x in np.split(packed, cut[1:])]
            none = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.array(own[cut]), pa.array(bucket[cut].astype(np.int32)), pa.array(parts, pa.binary())], schema=_ORDERED_ARROW)

    def run(batches):
        rows, held = [], 0
        for r in common.stream(batches, ("trigger", "shares", "share", "_id", "_dk", "at", "bytes")):
            if held > GROUP_BYTES and (r[0], r[2]) != (rows[-1][0], rows[-1][2]):
                yield from order(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[6])
        if rows:
            yield from order(rows)

    n = common.partitions(contexts.sparkSession)
    return contexts.repartition(n, "trigger", "share").sortWithinPartitions("trigger", "share").mapInArrow(common.tidy(run), _ORDERED)


def _across(packed: DataFrame, window: int) -> DataFrame:
    """Covered spans of suffixes that are first in their share but not over all shares."""
    from itertools import groupby

    def run(batches):
        for _, group in groupby(common.stream(batches, ("trigger", "bucket", "suffixes")), key=lambda r: r[:2]):
            x = np.concatenate([np.frombuffer(r[2], _SUFFIX) for r in group])
            x = x[_later((x["one"], x["two"]), x["id"], x["dk"], x["at"])]
            x = x[np.lexsort((x["at"], x["dk"], x["id"]))]
            spans = _runs(x["id"], x["dk"], x["at"].astype(np.int64), window)
            yield pa.RecordBatch.from_arrays([pa.array(spans[0]), pa.array(spans[1]), pa.array(spans[2].astype(np.int32)), pa.array(spans[3].astype(np.int32))], ["_id", "_dk", "s", "e"])

    n = common.partitions(packed.sparkSession)
    return packed.repartition(n, "trigger", "bucket").sortWithinPartitions("trigger", "bucket").mapInArrow(common.tidy(run), "_id long, _dk long, s int, e int")


def _tail() -> Column:
    """The upper 32 bits of _dk, then the place: one long in the order of document and place."""
    return F.col("_dk").bitwiseAND(-1 << 32).bitwiseOR(F.col("at").cast("long"))


def _dictionary(occurrences: DataFrame) -> DataFrame:
    """First occurrence of each phrase: e1, e2, trigger, f_id, f_tail, n. Long values with long orderings aggregate by hash.
    A document in several groups has several rows a phrase, and documents may share their doc_id, so the first within each
    _id is found before that over all."""
    rows = occurrences.where("NOT again").select("e1", "e2", "trigger", "_id", _tail().alias("tail"))
    firsts = rows.groupBy("e1", "e2", "_id").agg(F.min("tail").alias("tail"), F.first("trigger").alias("trigger"), F.count(F.lit(1)).alias("n"))
    return common.cut(firsts.groupBy("e1", "e2").agg(F.min("_id").alias("f_id"), F.min_by("tail", "_id").alias("f_tail"), F.first("trigger").alias("trigger"), F.sum("n").alias("n")), "dictionary")


def _chosen(dictionary: DataFrame) -> DataFrame:
    """Dictionary phrases that share their trigger with others, gathered by document."""
    counts = common.cut(dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trigger", "n", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "trigger-counts")
    share = F.pmod(F.col("e1"), F.col("shares")).cast("int")
    place = F.col("f_tail").bitwiseAND(0x7FFFFFFF).cast("int")
    rows = common.hot_join(dictionary.drop("n"), counts, "trigger").select(F.col("f_id").alias("_id"), F.shiftright("f_tail", 32).alias("_high"), F.struct(place.alias("at"), "shares", share.alias("share")).alias("x"))
    lists = rows.groupBy("_id", "_high").agg(F.collect_list("x").alias("x"))
    out = common.cut(lists.select("_id", "_high", F.col("x.at").alias("places"), F.col("x.shares").alias("shares"), F.col("x.share").alias("share")), "chosen")
    common.drop(counts)
    return out


def _copied(occurrences: DataFrame, dictionary: DataFrame, window: int) -> DataFrame:
    """Spans of phrases that are not the first of their bytes."""
    end = F.col("at") + F.col("windows") + window - 1
    several = dictionary.where("n > 1").select("e1", "e2", "f_id", "f_tail", "n")
    found = common.hot_join(occurrences.where("NOT again"), several, ["e1", "e2"]).where(~((F.col("f_id") == F.col("_id")) & (F.col("f_tail") == _tail())))
    return found.unionByName(occurrences.where("again"), allowMissingColumns=True).select("_id", "_dk", F.col("at").alias("s"), end.alias("e"))


def spans(docs: DataFrame, window: int = WINDOW, segment: int | None = None, group: int | None = None) -> DataFrame:
    """_id, _dk, spans (array of s, e in bytes, may overlap) of documents with repeated windows. Texts are parsed in
    segments of `segment` bytes and groups of `group` bytes (SEGMENT_BYTES, GROUP_BYTES), with the same result."""
    spark = docs.sparkSession
    segment, group = segment or SEGMENT_BYTES, group or GROUP_BYTES
    places = common.cut(_repeated_triggers(docs, window, segment, group), "places")
    common.release(spark)
    occurrences = common.cut(_occurrences(docs, places, window, segment, group), "occurrences")
    common.drop(places)
    common.release(spark)
    dictionary = _dictionary(occurrences)
    copied = common.cut(_copied(occurrences, dictionary, window), "copied")
    common.drop(occurrences)
    chosen = _chosen(dictionary)
    common.drop(dictionary)
    common.release(spark)
    ordered = common.cut(_ordered(_contexts(docs, chosen, window, segment, group), window), "ordered")
    common.drop(chosen)
    common.release(spark)
    found = copied.unionByName(ordered.where("_id IS NOT NULL").select("_id", "_dk", "s", "e")).unionByName(_across(ordered.where("suffixes IS NOT NULL").select("trigger", "bucket", "suffixes"), window))
    out = common.cut(found.groupBy("_id", "_dk").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    common.drop(copied, ordered)
    common.release(spark)
    return out


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def attach(docs: DataFrame, window: int = WINDOW, segment: int | None = None, group: int | None = None) -> tuple[DataFrame, str]:
    """All columns of docs with one more, the spans, and its name."""
    name = common.free("_spans", docs.columns)
    found = spans(docs, window, segment, group)
    rows = keyed(docs, F.struct(*(docs[c] for c in docs.columns)).alias("_row")).drop("_text").join(found, ["_id", "_dk"], "left")
    return rows.select("_row.*", F.col("spans").alias(name)), name


def digests(docs: DataFrame, window: int = WINDOW, segment: int | None = None, group: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(common.column(batch, c) for c in ("doc_id", "text", name))):
                data, runs = (text or "").encode(), merged(found)
                rows.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": sum(e - s for s, e in runs), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept_bytes(data, runs)).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    rows, name = attach(docs.select("doc_id", "text"), window, segment, group)
    return rows.mapInArrow(common.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(docs: DataFrame, window: int = WINDOW, segment: int | None = None, group: int | None = None) -> DataFrame:
    """docs, all columns, with repeats cut out of the texts (a character cut in part goes) and n_chars, if any, renewed."""

    def run(batches):
        for batch in batches:
            texts = []
            for text, found in zip(common.column(batch, "text"), common.column(batch, name)):
                texts.append(kept_bytes(text.encode(), merged(found)).decode("utf-8", "ignore") if found else text)
            columns = []
            for f in batch.schema:
                if f.name == name:
                    continue
                value = batch.column(batch.schema.get_field_index(f.name))
                if f.name == "text":
                    value = pa.array(texts, f.type)
                elif f.name == "n_chars":
                    value = pa.array([v if not found else len(t) for v, t, found in zip(value.to_pylist(), texts, common.column(batch, name))], f.type)
                columns.append((f.name, value))
            yield pa.RecordBatch.from_arrays([v for _, v in columns], [n for n, _ in columns])

    rows, name = attach(docs, window, segment, group)
    return rows.mapInArrow(common.tidy(run), docs.schema)
