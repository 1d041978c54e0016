"""Best-two-fit packing of token sequences.

Only piece lengths matter to a packing, and there are at most `capacity` of them. So the packing itself runs over the
histogram of lengths: a bin is filled greedily with the longest pieces that fit, then its smallest piece gives way to
two unpacked pieces that fill the widened gap better; the finished pattern is repeated while its lengths last. The
result is a short list of patterns (at most about capacity * ln(capacity), whatever the corpus). Pieces find their
places by rank among the pieces of their length; ranks come from counts per input partition, so no length, however
common, meets in one task.

Defined cases: null text is empty (one piece, the end id); repeated rows are packed each; equal lengths are ranked by
input partition and order; an empty table gives no rows; extra columns are ignored by pieces() and kept by place().
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import common, tokens

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Whole documents as pieces of at most `capacity` ids; of a longer document the first piece takes the remainder.

    Columns: part (input partition), lrank (rank in it among pieces of this length), doc_id, piece, start, length, ids.
    """
    model = tokenizer or tokens.tokenizer_path()
    schema = pa.schema([("part", pa.int32()), ("lrank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(common.column(batch, "doc_id"), common.column(batch, "text")):
                ids = tokens.document_ids(text, model, end_id)
                n = len(ids) // 4
                head = n % capacity or capacity
                for piece, start in enumerate([0, *range(head, n, capacity)]):
                    length = capacity if piece else min(head, n)
                    rows.append((part, seen[length], doc_id, piece, start, length, ids[4 * start : 4 * (start + length)]))
                    seen[length] += 1
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return common.texts(docs).mapInArrow(common.tidy(encode), "part int, lrank long, doc_id long, piece int, start long, length long, ids binary")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of a bin, how many such bins)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    found = []
    at_most = np.zeros(capacity + 1, np.int64)  # the longest length in stock up to each length

    def restock(lengths) -> None:
        """Stock has run out or come back at these lengths."""
        idx = np.where(left > 0, np.arange(capacity + 1), 0)
        np.maximum.accumulate(idx, out=at_most)

    restock(())
    while at_most[capacity]:
        bin_, gap = [], capacity
        while gap and (x := int(at_most[gap])):
            bin_.append(x)
            gap -= x
            left[x] -= 1
            if not left[x]:
                restock((x,))
        while gap and len(bin_) > 1:
            small = bin_[-1]
            wide = gap + small
            firsts = np.arange(1, wide)
            firsts = firsts[left[1:wide] > 0]
            if not len(firsts):
                break
            seconds = at_most[wide - firsts]
            seconds = np.where((seconds == firsts) & (left[firsts] < 2), at_most[np.minimum(seconds, wide - firsts) - 1], seconds)
            sums = np.where(seconds > 0, firsts + seconds, 0)
            k = int(np.argmax(sums))
            if sums[k] <= small:
                break
            pair = sorted((int(firsts[k]), int(seconds[k])), reverse=True)
            left[small] += 1
            for x in pair:
                left[x] -= 1
            restock((small, *pair))
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
            gap = capacity - sum(bin_)
        uses = Counter(bin_)
        more = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= more * n
        restock(uses)
        found.append((bin_, more + 1))
    return found


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (part, lrank, length and any payload)."""
    counts = common.cut(cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, uses a bin, first bin, offset
    given, bins = Counter(), 0
    for lengths, times in patterns(histogram, capacity):
        offset = 0
        for length, uses in sorted(Counter(lengths).items(), reverse=True):
            slots.setdefault(length, []).append((given[length], uses, bins, offset))
            given[length] += uses * times
            offset += uses * length
        bins += times
    table = {length: np.array(rows, np.int64).T for length, rows in slots.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "piece-offsets")
    earlier, rank_name = common.free("before", cut_pieces.columns), common.free("_rank", cut_pieces.columns)
    ranked = cut_pieces.join(offsets.withColumnRenamed("before", earlier).hint("merge"), ["part", "length"])  # offsets grow with the partitions: never broadcast
    ranked = ranked.withColumn(rank_name, F.col(earlier) + F.col("lrank")).drop(earlier, "part", "lrank")

    def locate(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index(rank_name)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, uses, bin_, off = table[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                j = rank[at] - first[k]
                sequence[at] = bin_[k] + j // uses[k]
                offset[at] = off[k] + j % uses[k] * x
            keep = [f.name for f in batch.schema if f.name != rank_name]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank_name)
    return ranked.mapInArrow(common.tidy(locate), f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(common.cut(pieces(docs, capacity, tokenizer), "pieces"), capacity)
