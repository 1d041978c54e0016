"""MinHash near-duplicates by an inverted join on signature coordinates.

1. A document's set of distinct 5-word shingles gives a signature of COORDINATES minima. Documents with equal sets are
   one class from here on, so exact copies cost nothing.
2. Every class is posted under each of its coordinate-value pairs. Two classes as similar as asked share at least
   `matches` pairs (but for a chance of MISS), so, pairs in order of rising frequency, they meet within the first
   COORDINATES - matches + 1 of each: only those prefixes are merged, the frequent rest is skipped.
3. Every list is merged with its smallest member, its leader: a row a member, never a row a pair of members. Of these
   pairs the collisions over the whole signatures are counted; those above the threshold are confirmed on full sets.
   So a group of N near copies costs N comparisons, and its members are one component.
4. What a leader can't settle: a list whose other members are still of several components. Such lists are gathered by
   leader and compared in blocks, members of different components only, counting collisions and confirming as before; a
   task hands on a spanning forest of its links. Blocks are bounded in members and shingles whatever the group's size,
   and a large component has blocks of its own, which are never compared with each other. No list, group or pair is dropped.
5. Components of the links give the result.

Keys that hold a large share of the rows are few, and are joined by broadcast (common.hot_join).

Defined cases: a text with fewer words than a shingle is one shingle; null, empty and blank texts have the empty set and
no link; a null doc_id is linked to nothing; documents with equal doc_ids are one node; ties don't arise, as ids are
compared as numbers; an empty table gives no rows; extra columns are dropped by near_duplicates(), kept by dedup().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import common, graph, hashing

WORDS = 5
COORDINATES = 64
#: The chance that a pair just similar enough has too few collisions.
MISS = 1e-8
BLOCK_MEMBERS = 192
BLOCK_SHINGLES = 400_000
#: Members compared with their leader together: a row each, so a part may be small and a large list meets many tasks.
STAR_MEMBERS = 32
_MULTIPLIERS = hashing.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
#: The white space that parts words.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.isin(np.arange(256), list(WHITE_SPACE))


def least_matches(percent: int) -> int:
    """Collisions that a pair of this similarity has but for a chance of MISS: the quantile of a binomial count."""
    s, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if below > MISS:
            return k
    return COORDINATES


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the text each is in, and where each starts and ends in the texts laid end to end."""
    raw = [t.encode().lower() for t in texts]  # bytes: lower-cases A-Z alone
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    space = _IS_SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hashing.Ranges(data).of(start, end), np.searchsorted(ends_of, start, "right"), start, end


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Per text its sorted set of distinct shingle hashes."""
    hashes, doc, _, _ = word_hashes(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    whole = hashes
    for k in range(1, words):
        whole = hashing.pair_hash(whole[: len(hashes) - k], hashes[k:]) if len(hashes) > k else whole[:0]
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            one = hashes[a : a + 1]
            for k in range(a + 1, b):
                one = hashing.pair_hash(one, hashes[k : k + 1])
            out.append(one)
        else:
            out.append(hashes[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES minima a set; no set may be empty."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint32)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat((flat * m) >> np.uint64(32), at).astype(np.uint32) for m in _MULTIPLIERS], 1)


def in_pieces(texts: list[str], most: int = 1 << 18) -> Iterator[slice]:
    """Slices of texts of about `most` characters together."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held > most:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and key of the set (null: empty), signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("key", pa.int64()), ("signature", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            ids, texts = common.column(batch, "doc_id"), common.column(batch, "text")
            for part in in_pieces(texts):
                sets = shingle_sets(texts[part])
                rows = iter(signatures([s for s in sets if len(s)]).view(np.int32))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                        pa.array([next(rows) if d else None for d in digests], pa.list_(pa.int32())),
                    ],
                    schema=schema,
                )

    return common.texts(docs).mapInArrow(common.tidy(run), "doc_id long, n_shingles long, digest binary, key long, signature array<int>")


def _prefixes(classes: DataFrame, matches: int) -> tuple[DataFrame, DataFrame]:
    """node, post: the lists each class is merged in; post, a, n: their leaders and lengths."""
    posts = classes.select("key", "node", F.posexplode("signature").alias("_k", "_v")).select(
        "key", "node", F.shiftleft(F.col("_k").cast("long"), 32).bitwiseOR(F.col("_v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("post")
    )
    shared = common.cut(posts.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("post", "n"), "shared-posts")
    live = common.hot_join(posts, shared, "post").groupBy("key", "node").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("live"))  # at most COORDINATES a class
    prefix = common.cut(
        live.where(F.size("live") >= matches).select("node", F.explode(F.slice("live", F.lit(1), F.size("live") - matches + 1)).alias("p")).select("node", "p.post").distinct(), "prefixes"
    )
    leads = common.cut(prefix.groupBy("post").agg(F.min("node").alias("a"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).where("a < hi").select("post", "a", "n"), "leads")
    common.drop(shared)
    return prefix, leads


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links, those that join what was apart."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def block_links(nodes: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, matches: int, percent: int, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links between members of left and right (masks over members), as a spanning forest; members of equal
    `settled` aren't compared."""
    sign = signatures(sets)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    collide = np.zeros((len(a), len(b)), np.int16)
    for k in range(COORDINATES):
        collide += sign[a, k][:, None] == sign[b, k][None]
    maybe = collide >= matches
    if settled is not None:
        maybe &= settled[a][:, None] != settled[b][None]
    if not maybe.any():
        return []
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common_size = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        i, j = np.searchsorted(column, (low, low + 8192))
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[i:j], column[i:j] - low] = 1
        common_size += x[a] @ x[b].T
    both = common_size.astype(np.int64)
    union = size[a][:, None] + size[b][None] - both
    yes = maybe & (100 * both >= percent * union)
    return forest([(nodes[a[i]], nodes[b[j]]) for i, j in zip(*np.nonzero(yes)) if nodes[a[i]] != nodes[b[j]]])


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (doc_id and others) with the shingle set of each of the document's texts."""
    names = wanted.columns
    rows = common.texts(docs).join(wanted, "doc_id").dropDuplicates([*names, "text"])

    def sets_of(batches):
        for batch in batches:
            texts = common.column(batch, "text")
            for part in in_pieces(texts):
                got = [s.tobytes() for s in shingle_sets(texts[part])]
                cut = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(cut.column(cut.schema.get_field_index(n)) for n in names), pa.array(got, pa.binary())], [*names, "shingles"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return rows.select(*names, "text").mapInArrow(common.tidy(sets_of), f"{fields}, shingles binary")


def _star_links(docs: DataFrame, classes: DataFrame, prefix: DataFrame, leads: DataFrame, matches: int, percent: int) -> DataFrame:
    """Confirmed links a, b of members with the leaders of their lists."""
    pairs = common.cut(common.hot_join(prefix, leads, "post").where("node != a").select("a", F.col("node").alias("b")).distinct(), "stars")
    signature = classes.select("node", "signature")
    sizes = common.cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "star-sizes")
    told = common.hot_join(pairs.join(signature.withColumnsRenamed({"node": "b", "signature": "_b"}), "b"), sizes.join(signature.withColumnsRenamed({"node": "a", "signature": "_a"}), "a"), "a")
    collisions = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    likely = common.cut(told.where(collisions >= matches).select("a", "b").distinct(), "likely")
    parts = common.cut(likely.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "star-parts")
    members = common.hot_join(likely, parts, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR_MEMBERS)).cast("int").alias("part"), F.lit(1).alias("role"))
    leaders = parts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / STAR_MEMBERS).cast("int") - 1)).alias("part"), F.lit(0).alias("role"))

    def compare(batches):
        at, lead, found = None, [], []
        for a, part, role, b, raw in common.stream(batches, ("a", "part", "role", "doc_id", "shingles")):
            if at != (a, part):
                at, lead = (a, part), []
            own = np.frombuffer(raw, np.uint64)
            if not role:
                lead.append(own)
                continue
            for other in lead:
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((a, b))
                    break
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    keyed = _with_sets(docs, members.unionByName(leaders)).repartition(common.partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role", "doc_id")
    links = common.cut(keyed.mapInArrow(common.tidy(compare), "a long, b long"), "star-links")
    common.drop(pairs, sizes, likely, parts)
    return links


def _rest_links(docs: DataFrame, classes: DataFrame, prefix: DataFrame, leads: DataFrame, joined: DataFrame, matches: int, percent: int) -> DataFrame:
    """Confirmed links a, b within lists whose members, leader aside, are of several components (joined: node, component)."""
    rows = prefix.join(joined, "node", "left").select("post", "node", F.coalesce("component", "node").alias("own"))
    open_ = common.cut(common.hot_join(rows, leads, "post").where("node != a").groupBy("post").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.min("a").alias("a"), F.max("n").alias("n")).where("lo < hi").select("post", "a", "n"), "open-lists")
    members = common.cut(common.hot_join(rows, open_, "post").where("node != a").select("a", "node", "own").distinct(), "open-members")
    sized = members.join(classes.groupBy("node").agg(F.sum("n_shingles").alias("size")), "node").groupBy("a", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    home = F.when(F.col("n") * 2 >= BLOCK_MEMBERS, F.col("own"))  # small components share blocks (home null)
    homes = common.cut(sized.groupBy("a", home.alias("home")).agg(F.greatest(F.ceil(F.sum("n") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "homes")
    numbered = homes.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("home", "blocks"))).alias("homes"), F.sum("blocks").alias("all"))
    groups = common.cut(numbered.join(members.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").select("a", "homes", F.col("all").cast("int").alias("all"), "n"), "open-groups")
    # a member's blocks begin after those of the homes before its own
    mine = F.filter("homes", lambda h: h.home.eqNullSafe(F.col("home")))[0]
    before = F.aggregate(F.filter("homes", lambda h: (F.col("home").isNotNull() & h.home.isNull()) | F.coalesce(h.home < F.col("home"), F.lit(False))), F.lit(0), lambda x, h: x + h.blocks)
    named = F.when(F.exists("homes", lambda h: F.coalesce(h.home == F.col("own"), F.lit(False))), F.col("own"))
    placed = (
        common.hot_join(members, groups, "a").withColumn("home", named).withColumn("first", before).withColumn("blocks", mine.blocks)
        .withColumn("i", (F.col("first") + F.pmod(F.xxhash64(F.when(F.col("home").isNull(), F.col("own")).otherwise(F.col("node"))), F.col("blocks"))).cast("int"))
        .select(F.col("node").alias("doc_id"), "a", "own", "i", F.when(F.col("home").isNotNull(), F.col("first")).otherwise(F.lit(-1)).alias("low"), F.when(F.col("home").isNotNull(), F.col("first") + F.col("blocks")).otherwise(F.lit(-1)).alias("high"), "all")
    )
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: (k < F.col("low")) | (k >= F.col("high"))))
    spread = _with_sets(docs, placed).withColumn("k", others).select("doc_id", "a", "own", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), (F.col("i") <= F.col("k")).alias("left"), (F.col("i") >= F.col("k")).alias("right"), "shingles")

    def compare(batches):
        for _, group in groupby(common.stream(batches, ("a", "i", "j", "doc_id", "own", "left", "right", "shingles")), key=lambda r: r[:3]):
            group = list(group)
            if len(group) < 2:
                continue
            sets = [np.frombuffer(r[7], np.uint64) for r in group]
            own, left, right = (np.array([r[k] for r in group]) for k in (4, 5, 6))
            found = block_links([r[3] for r in group], sets, left, right, matches, percent, own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    keyed = spread.repartition(common.partitions(docs.sparkSession), "a", "i", "j").sortWithinPartitions("a", "i", "j", "doc_id")
    links = common.cut(keyed.mapInArrow(common.tidy(compare), "a long, b long"), "rest-links")
    common.drop(open_, members, homes, groups)
    return links


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links have 100 * intersection >= percent * union."""
    matches = least_matches(percent)
    signed = common.cut(_signed(docs), "signed")
    classes = common.cut(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes"
    )
    prefix, leads = _prefixes(classes, matches)
    stars = _star_links(docs, classes, prefix, leads, matches, percent)
    by_star = graph.components(stars)
    rest = _rest_links(docs, classes, prefix, leads, by_star, matches, percent)
    joined = by_star if rest.isEmpty() else graph.components(by_star.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest))
    named = common.cut(classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "named-classes")
    common.drop(classes, prefix, leads, stars, rest, by_star, joined)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without near copies of another kept document."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(common.cut(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
