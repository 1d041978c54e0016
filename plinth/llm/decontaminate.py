"""Benchmark decontamination by SimHash windows.

A window has as many words as a benchmark item. It and the item have fingerprints of 128 bits: the signs of sums over
their 5-word shingles, each with its weight and its multiplicity. The fingerprint is cut into 8 blocks of 16 bits; two
fingerprints within RADIUS bits agree in some block but for RADIUS // 8 bits, so an index from every block value near an
item's to the item finds all items within the radius. Candidates are then verified by exact weighted similarity (sum of
minima over sum of maxima). Windows that hold no shingle of any item have similarity 0 and get no fingerprint.

A pair at a similarity of 0.8 is beyond the radius with a chance of about 1e-5 if its shingles weigh the same and occur
once; uneven weights or multiplicities can put most such pairs beyond it. So beside the index, every item whose weight in
a region of hits can reach the threshold has its similarity to all windows there computed from running sums, exactly: no
pair as similar as asked is lost, whatever the weights.

A shingle's weight is HEAVIEST over the number of distinct benchmark texts that hold it, counted over the whole benchmark.
The index of ITEMS_AT_ONCE items is held in a task at most; a larger benchmark is taken in that many passes, which all
use the same weights, so the passes bound memory and change no result. The corpus is scanned once, for documents that hold
a shingle of any item (or a whole short item); passes read those alone.

Defined cases: null and empty texts hold nothing; a document shorter than an item is one window for it; items of fewer
than 5 words are found as they are; items without words, or with a null text, are skipped; of windows that tie the first
counts; repeated rows and items get rows each; an empty table on either side gives no rows; extra columns are dropped by
matches() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import common, hashing, minhash

WORDS = minhash.WORDS
SIMILARITY = 0.8
BITS, BLOCKS = 128, 8
RADIUS = 38
ITEMS_AT_ONCE = 500
HEAVIEST = 8
_FILTER_BITS = 22


def chains(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words."""
    whole = hashes
    for j in range(1, k):
        whole = hashing.pair_hash(whole[: len(hashes) - j], hashes[j:]) if len(hashes) > j else whole[:0]
    return whole


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS values of 1 or -1 a shingle."""
    words = np.stack([shingles, hashing.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], 1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of sums as rows of BLOCKS 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Weighted multisets: sum of minima over sum of maxima."""
    values, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(side[: len(a)], minlength=len(values)), np.bincount(side[len(a) :], minlength=len(values))
    w = weight(values)
    most = (np.maximum(x, y) * w).sum()
    return float((np.minimum(x, y) * w).sum() / most) if most else 0.0


def shared(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several distinct texts hold, in order, and their weights; every other shingle weighs HEAVIEST."""
    sets = [np.unique(chains(minhash.word_hashes([t])[0], WORDS)) for t in set(texts)]
    values, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    several = times > 1
    return values[several], np.maximum(1, HEAVIEST // times[several])


class Index:
    """Benchmark items, ready to be looked for. Weights are those of the whole benchmark (shared() of all its texts); by
    default the items are the whole."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = SIMILARITY, weights: tuple[np.ndarray, np.ndarray] | None = None):
        self.threshold = threshold
        self.light, self.weights = shared(t for _, t in items) if weights is None else weights
        self.learn(items)
        self.sizes = np.array(self.sizes, np.int64)
        self.sets = [np.unique(s, return_counts=True) for s in self.shingles]
        self.totals = np.array([self.weight(s).sum() for s in self.shingles], np.int64)
        held, times = (np.concatenate(x) if x else np.zeros(0, t) for x, t in (([v for v, _ in self.sets], np.uint64), ([n for _, n in self.sets], np.int64)))
        order = np.argsort(held, kind="stable")  # by shingle: the items that hold it, and how often
        self.held, self.held_times = held[order], times[order]
        self.holder = np.repeat(np.arange(len(self.sets)), [len(v) for v, _ in self.sets])[order]
        self.blocks = np.zeros((len(self.ids), BLOCKS), np.uint16)
        for k, s in enumerate(self.shingles):
            self.blocks[k] = fingerprints((signs(s) * self.weight(s)[:, None]).sum(0, keepdims=True))[0]
        near = RADIUS // BLOCKS
        flips = np.array([sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(16), n)], np.uint16)
        self.widths, rank = np.unique(self.sizes, return_inverse=True)
        self.posting = []  # by block: (size, value near an item's block), in order, and the item
        for block in self.blocks.T:
            code = (rank[:, None] << 16 | (block[:, None] ^ flips[None])).ravel().astype(np.uint32)
            order = np.argsort(code, kind="stable")
            self.posting.append((code[order], (order // len(flips)).astype(np.int32)))

    def learn(self, items: list[tuple[int, str]]) -> None:
        """The items' words and shingles, and what tells a shingle that some item has."""
        self.ids, self.sizes, self.shingles = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            hashes = minhash.word_hashes([text])[0]
            if len(hashes) >= WORDS:
                self.ids.append(item_id)
                self.sizes.append(len(hashes))
                self.shingles.append(chains(hashes, WORDS))
            elif len(hashes):
                self.short.setdefault(len(hashes), {}).setdefault(int(chains(hashes, len(hashes))[0]), []).append(item_id)
        every = np.concatenate([np.unique(s) for s in self.shingles]) if self.shingles else np.zeros(0, np.uint64)
        self.known = np.unique(every)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.known & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.light):
            return np.full(len(shingles), HEAVIEST)
        k = np.minimum(np.searchsorted(self.light, shingles), len(self.light) - 1)
        return np.where(self.light[k] == shingles, self.weights[k], HEAVIEST)

    def holds(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        out = self.filter[shingles & np.uint64((1 << _FILTER_BITS) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            k = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            out[at] = self.known[k] == shingles[at]
        return out

    def near(self, prints: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS, of windows and items of one size (given by its rank)."""
        pairs = []
        high = rank.astype(np.uint32) << np.uint32(16)
        for (codes, items), value in zip(self.posting, prints.T):
            code = high | value
            first = np.searchsorted(codes, code, "left")
            some = np.flatnonzero(codes[np.minimum(first, len(codes) - 1)] == code)
            first = first[some]
            count = np.searchsorted(codes, code[some], "right") - first
            item = items[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            pairs.append(np.repeat(some, count) * len(self.ids) + item)
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.ids))
        far = np.bitwise_count(prints[window] ^ self.blocks[item]).sum(1) > RADIUS
        return window[~far], item[~far]

    def find(self, hashes: np.ndarray, shingles: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Hits in a document, from its words, its shingles and the places of those that some item has: item_id, first
        word, number of words, similarity; the best window of each item."""
        best: dict[int, tuple[float, int, int]] = {}
        firsts: dict[int, tuple[int, int, int, float]] = {}
        for k, wanted in self.short.items():
            chain = chains(hashes, k)
            for at in np.flatnonzero(np.isin(chain, np.array(list(wanted), np.uint64))).tolist():
                for item in wanted[int(chain[at])]:
                    firsts.setdefault(item, (item, at, k, 1.0))
        if len(hit):
            self._windows(shingles, hit, len(hashes), best)
        return [*firsts.values(), *((self.ids[item], at, size, s) for item, (s, at, size) in sorted(best.items()))]

    def _windows(self, shingles: np.ndarray, hit: np.ndarray, n: int, best: dict) -> None:
        widest = int(self.sizes.max())
        gaps = np.flatnonzero(np.diff(hit) > 2 * widest)
        for low, high in zip(hit[np.concatenate([[0], gaps + 1])].tolist(), hit[np.concatenate([gaps, [len(hit) - 1]])].tolist()):
            start, stop = max(0, low - widest + WORDS), min(len(shingles), high + widest - WORDS + 1)
            own = shingles[start:stop]
            for block in range(0, stop - start, 1 << 14):  # long regions in overlapping parts
                self._region(own[block : block + (1 << 14) + widest], start + block, hit, n, best)

    def _region(self, own: np.ndarray, start: int, hit: np.ndarray, n: int, best: dict) -> None:
        sums = np.zeros((len(own) + 1, BITS), np.int32)
        np.cumsum(signs(own) * self.weight(own)[:, None], axis=0, out=sums[1:])
        near_hit = np.zeros(len(own) + 1, np.int64)
        inside = hit[(hit >= start) & (hit < start + len(own))] - start
        near_hit[inside + 1] = 1
        near_hit = np.cumsum(near_hit)
        prints, ranks, starts, widths = [], [], [], []
        for rank, size in enumerate(self.widths.tolist()):
            width = size - WORDS + 1
            if width > len(own):
                if start or len(own) < n - WORDS + 1:
                    continue
                width = len(own)  # the whole of a shorter document
            at = np.flatnonzero(near_hit[width:] > near_hit[: len(near_hit) - width])
            if len(at):
                prints.append(fingerprints(sums[at + width] - sums[at]))
                ranks.append(np.full(len(at), rank))
                starts.append(at)
                widths.append(np.full(len(at), width))
        if not prints:
            return
        starts, widths = np.concatenate(starts).tolist(), np.concatenate(widths).tolist()
        for w, item in zip(*(x.tolist() for x in self.near(np.concatenate(prints), np.concatenate(ranks)))):
            s = similarity(own[starts[w] : starts[w] + widths[w]], self.shingles[item], self.weight)
            first = start + starts[w]
            self._keep(best, item, s, first, n)
        for item, s, at in self._reaching(own, inside, not start and len(own) == n - WORDS + 1):
            self._keep(best, item, s, start + at, n)

    def _keep(self, best: dict, item: int, s: float, first: int, n: int) -> None:
        if s >= self.threshold and (item not in best or (-s, first) < (-best[item][0], best[item][1])):
            best[item] = (s, first, min(int(self.sizes[item]), n))

    def _reaching(self, own: np.ndarray, inside: np.ndarray, whole: bool) -> Iterator[tuple[int, float, int]]:
        """Items with a window in this region that reaches the threshold: item, similarity and start of the best window.
        The hits are at the places inside; a region that is a whole document is one window for longer items."""
        hits, weights = own[inside], self.weight(own)
        values, times = np.unique(hits, return_counts=True)
        first = np.searchsorted(self.held, values, "left")
        count = np.searchsorted(self.held, values, "right") - first
        row = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        most = np.minimum(np.repeat(times, count), self.held_times[row]) * np.repeat(self.weight(values), count)
        able = np.bincount(self.holder[row], most, len(self.ids)) >= self.threshold * self.totals * (1 - 1e-9)
        up_to = np.concatenate([[0], np.cumsum(weights)])
        for item in np.flatnonzero(able).tolist():
            width = int(self.sizes[item]) - WORDS + 1
            if width > len(own):
                if not whole:
                    continue
                width = len(own)
            values, times = self.sets[item]
            which = np.minimum(np.searchsorted(values, hits), len(values) - 1)
            found = np.flatnonzero(values[which] == hits)
            found = found[np.argsort(which[found], kind="stable")]
            which, place = which[found], inside[found]
            # an occurrence counts in windows that hold it, but not the one that is as many before as the item has
            before = np.arange(len(found)) - times[which]
            full = (before >= 0) & (which[before] == which)
            low = np.maximum(np.where(full, place[before] + 1, 0), place - width + 1)
            windows = len(own) - width + 1
            gain = weights[place]
            change = np.bincount(np.clip(low, 0, windows), gain, windows + 1) - np.bincount(np.minimum(place + 1, windows), gain, windows + 1)
            least = np.cumsum(change)[:windows]
            s = least / (self.totals[item] + up_to[width:] - up_to[:windows] - least)
            at = int(np.argmax(s))
            if s[at] >= self.threshold:
                yield item, float(s[at]), at


def _passes(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in groups of about ITEMS_AT_ONCE."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    groups = -(-items.count() // ITEMS_AT_ONCE)
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, groups)))
    return [[(r.item_id, r.text) for r in items.where(own == k).orderBy("item_id", "text").collect()] for k in range(groups)]


def _touched(items: list[tuple[int, str]]):
    """A filter over batches: documents that hold a shingle of some item, or all words of an item of fewer."""
    chosen = Index([], weights=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    chosen.learn(items)

    def run(batches):
        for batch in batches:
            keep = []
            texts = [t or "" for t in common.column(batch, "text")]
            for part in minhash.in_pieces(texts):
                hashes, doc, _, _ = minhash.word_hashes(texts[part])
                found = np.zeros(part.stop - part.start, bool)
                for k, wanted in [(WORDS, None), *chosen.short.items()]:
                    chain = chains(hashes, k)
                    if len(chain):
                        hit = chosen.holds(chain) if wanted is None else np.isin(chain, np.array(list(wanted), np.uint64))
                        found[doc[: len(chain)][hit & (doc[: len(chain)] == doc[k - 1 :])]] = True
                keep.append(found)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return run


def _documents_hits(texts: list[str], index: Index):
    """Hits of each text in turn."""
    for part in minhash.in_pieces(texts):
        hashes, doc, _, _ = minhash.word_hashes(texts[part])
        edges = np.searchsorted(doc, np.arange(part.stop - part.start + 1)).tolist()
        shingles = chains(hashes, WORDS)
        hit = np.flatnonzero(index.holds(shingles) & (doc[: len(shingles)] == doc[WORDS - 1 :])) if len(index.ids) and len(shingles) else np.zeros(0, np.int64)
        inside = np.searchsorted(hit, edges).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            own = hit[inside[k] : inside[k + 1]] - a
            yield index.find(hashes[a:b], shingles[a : max(a, b - WORDS + 1)], own) if len(own) or index.short else []


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of every item found in every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    text = "doc_id long, item_id long, first_word long, n_words long, similarity double"

    passes = _passes(benchmark)
    weights = shared(t for items in passes for _, t in items)
    rows = common.texts(docs)
    if len(passes) > 1:
        rows = common.cut(rows.mapInArrow(common.tidy(_touched([i for items in passes for i in items])), "doc_id long, text string"), "touched")

    def one(items):
        def run(batches):
            index = Index(items, threshold, weights)
            for batch in batches:
                ids = common.column(batch, "doc_id")
                rows = [(i, *h) for i, hits in zip(ids, _documents_hits(common.column(batch, "text"), index)) for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        return rows.mapInArrow(common.tidy(run), text)

    out = None
    for items in passes:
        out = one(items) if out is None else out.unionByName(one(items))
    return docs.sparkSession.createDataFrame([], text) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    out = docs
    common.small_batches(docs.sparkSession)
    passes = _passes(benchmark)
    weights = shared(t for items in passes for _, t in items)

    def without(items):
        def run(batches):
            index = Index(items, threshold, weights)
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in _documents_hits([t or "" for t in common.column(batch, "text")], index)], pa.bool_()))

        return run

    for items in passes:
        out = out.mapInArrow(common.tidy(without(items)), docs.schema)
    return out
