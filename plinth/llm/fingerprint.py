"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (a shift and a table value a byte, so it knows the last 32 bytes). A chunk ends
where the hash has its top bits clear: more bits are asked for below the normal size and fewer above it, which keeps
sizes close to it. Boundaries depend on nearby bytes alone, so an edit changes the chunks around it only. A fingerprint
is the set of chunk digests with chunk lengths; its likeness to another is the share of its own length that the other
set holds too (containment).

Defined cases: null text is empty; an empty text has the empty fingerprint, alike (1) to an empty one and unlike (0) to
others; a null doc_id comes last in descending order; equal doc_ids are ordered by a hash of the text; repeated rows get a row each;
texts are read whole; a single document is its own neighbour; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import common, hashing

MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 4
#: Rows of the sample that part bounds come from, a part.
SAMPLED = 8
_GEAR = (hashing.TABLES[0] >> np.uint64(16)).astype(np.uint32)
_LOWEST = -(1 << 63)


def cuts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts and ends over texts laid end to end; ends: where each text ends. No chunk spans two texts: a cut
    within MIN_BYTES (what the hash knows) of a text's start isn't looked for."""
    gear = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        gear[k:] += gear[:-k] << np.uint32(k)
    strict = (np.flatnonzero(gear < np.uint32(1 << 32 - STRICT_BITS)) + 1).tolist()
    loose = (np.flatnonzero(gear < np.uint32(1 << 32 - LOOSE_BITS)) + 1).tolist()
    starts, stops = [], []
    at = i = j = 0
    for end in ends.tolist():
        while at < end:
            low, mid, high = at + MIN_BYTES, at + NORMAL_BYTES, min(at + MAX_BYTES, end)
            i = bisect_left(strict, low, i)
            if i < len(strict) and strict[i] < min(mid, high):
                stop = strict[i]
            else:
                j = bisect_left(loose, mid, j)
                stop = min(loose[j], high) if j < len(loose) else high
            starts.append(at)
            stops.append(stop)
            at = stop
    return np.array(starts, np.int64), np.array(stops, np.int64)


def chunk_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted set of its chunks, each as 48 bits of digest and 16 of length."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    starts, stops = cuts(data, ends)
    marks = hashing.Ranges(data).of(starts, stops) & ~np.uint64(0xFFFF) | (stops - starts).astype(np.uint64)
    return [np.unique(x) for x in np.split(marks, np.searchsorted(starts, ends[:-1]))] if len(texts) else []


def encode(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How much of a, by length, is in b."""
    if not len(a):
        return float(not len(b))
    if not len(b):
        return 0.0
    length = (a & np.uint64(0xFFFF)).astype(np.int64)
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(length[b[k] == a].sum() / length.sum())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(rows: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where parts but the first begin, in order: rows of a hash sample (SAMPLED a part), with the first row of all at the
    end. Bounds even the parts out; they change no result."""
    count = rows.count()
    if not count:
        return None
    stride = max(1, count // (SAMPLED * parts))
    sample = rows.where(F.pmod(F.xxhash64("_place", "_mix"), F.lit(stride)) == 0).select("_place", "_mix").distinct().collect()  # SAMPLED rows a part
    marks = sorted((r._place, r._mix) for r in sample)
    top = rows.agg(F.min("_place")).first()[0]
    first = (top, rows.where(F.col("_place") == top).agg(F.min("_mix")).first()[0])
    chosen = sorted({marks[k * len(marks) // parts] for k in range(1, parts)} if marks else set())
    both = np.array([*chosen, first], np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _part(place: np.ndarray, mix: np.ndarray, places: np.ndarray, mixes: np.ndarray) -> np.ndarray:
    """How many bounds (in order) each row is not before."""
    low, high = np.searchsorted(places, place, "left"), np.searchsorted(places, place, "right")
    out = low.copy()
    for k in np.unique(low[high > low]).tolist():
        at = np.flatnonzero((low == k) & (high > low))
        out[at] = k + np.searchsorted(mixes[k : high[at[0]]], mix[at], "right")
    return out


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows in descending doc_id order within parts, each part followed by the row that comes next: _part, _halo, doc_id,
    text. Text is shuffled once; a bounded sample a part reaches the driver, and the bounds go to the tasks as an array."""
    spark = docs.sparkSession
    parts = max(64, 4 * common.partitions(spark))
    rows = common.texts(docs).select("doc_id", "text", F.bitwise_not(F.coalesce("doc_id", F.lit(_LOWEST))).alias("_place"), F.xxhash64("text").alias("_mix"))
    found = _bounds(rows, parts)
    if found is None:
        return rows.select(F.lit(0).alias("_part"), F.lit(0).alias("_halo"), "doc_id", "text")
    places, mixes = found[0][:-1], found[1][:-1]
    top = (found[0][-1], found[1][-1])

    def deal(batches):
        """Rows with their part; the first row of a part once more, for the part before it."""
        for batch in batches:
            place, mix = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("_place", "_mix"))
            part = _part(place, mix, places, mixes)
            k = np.maximum(part - 1, 0)
            begins = np.flatnonzero((part > 0) & (places[k] == place) & (mixes[k] == mix)) if len(places) else np.zeros(0, np.int64)
            ends = np.flatnonzero((place == top[0]) & (mix == top[1]))  # after the last part comes the first row of all
            take = np.concatenate([np.arange(len(part)), begins, ends])
            where = np.concatenate([part, part[begins] - 1, np.full(len(ends), len(places))])
            halo = (np.arange(len(take)) >= len(part)).astype(np.int32)
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(halo), *out.columns], ["_part", "_halo", *out.schema.names])

    spread = rows.mapInArrow(common.tidy(deal), "_part int, _halo int, doc_id long, text string, _place long, _mix long")
    return spread.repartition(common.partitions(spark), "_part").sortWithinPartitions("_part", "_halo", "_place", "_mix", "text")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches):
        """Each row with the row after it in its part."""
        held = None
        for batch in batches:
            for row in zip(*(common.column(batch, c) for c in ("_part", "_halo", "doc_id", "text"))):
                if held and held[0] == row[0] and not held[1]:
                    yield held[2], held[3], row[3]
                held = row

    def emit(group):
        own = [g[1] for g in group]
        changed = [edited(t, after) for _, t, after in group]
        sets = chunk_sets([*own, *changed, *(g[2] for g in group[-1:])])
        k = len(group)
        follow = [*sets[1:k], sets[2 * k]]
        for i in range(k - 1):
            if group[i][2] is not own[i + 1]:
                follow[i] = chunk_sets([group[i][2]])[0]
        columns = zip(*(
            (g[0], len(g[1]), hashlib.sha256(e.encode()).hexdigest(), encode(a), encode(b), likeness(a, b), likeness(a, f))
            for g, e, a, b, f in zip(group, changed, sets, sets[k:], follow)
        ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        group, size = [], 0
        for row in pairs(batches):
            group.append(row)
            size += len(row[1])
            if size > 1 << 20:
                yield emit(group)
                group, size = [], 0
        if group:
            yield emit(group)

    return neighbours(docs).select("_part", "_halo", "doc_id", "text").mapInArrow(
        common.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
