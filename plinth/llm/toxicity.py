"""Toxicity by weak supervision.

1. Voters. A lexicon voter is a word beginning (SHORTEST characters or more) with the number of words of a text that must
   begin so; a pattern voter is a form of writing. All beginnings, counts and patterns of the labelled sample are tested:
   those become voters that speak on toxic rows far more often than on others (LIFT, and a likelihood ratio of
   SIGNIFICANCE). Of voters that speak on nearly the same rows (SAME) the most telling one stays. There is no list of words
   and no bound on the voters.
2. Label model. Voters speak or abstain; abstaining says nothing. The model has a rate of speaking for each voter and
   class, and correlations: each voter may depend on one other, its parent in the tree of largest conditional mutual
   information. Rates, correlations and tree come from expectation maximisation over the votes of all sample rows; counts
   over gold labels are their prior, the share of toxic labels is the prior of the class. The posterior of a row comes
   from its votes alone, so voters that agree overrule a gold label.
3. A linear classifier is trained on the posterior labels and scores every document.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. The fit sees a bounded sample of them: the
first MAX_TOXIC and MAX_CLEAN in hash order, equal texts once. Everything else covers all rows.

Defined cases: null and empty texts get the score of a text without any vote; a null doc_id has the checksum of the
empty text; repeated rows get equal scores; without labelled rows of both classes, or without any voter, every text gets
the score CLEAN; texts of any length are read whole; an empty table gives no rows; extra columns are dropped by score()
and kept by keep_clean().
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import common, hashing, minhash

FOLDS = 5
#: The bound of the labelled sample that is learnt from.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
SHORTEST = 4
#: A voter speaks on toxic rows LIFT times as often as on others, with this likelihood ratio (30: a chance of 4e-8).
LIFT, SIGNIFICANCE = 4.0, 30.0
#: A longer beginning votes beside a shorter one if its odds are so many times better.
BETTER = 2.0
#: Voters whose rows overlap by this share (intersection over union) are one voter.
SAME = 0.5
CLEAN = 0.02
#: Counts sent on at once while beginnings are counted.
_HELD = 200_000
_WORD = re.compile("[a-z0-9\u0080-\U0010ffff]+")
#: Patterns of form that may vote.
PATTERNS = {"shouting": r"[A-Z]{4,}", "exclaiming": r"!!", "masked": r"[A-Za-z][*$#@%&]{2,}", "linking": r"https?://"}
_FORMS = {"/" + name: re.compile(p).search for name, p in PATTERNS.items()} | {"/repeating": lambda text: _repeats(_WORD.findall(text.lower()))}
_IS_LETTER = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_GATE_BITS = 20

Voter = tuple[str, int]


def fold(doc_id: Column) -> Column:
    """0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _repeats(words: list[str]) -> bool:
    return any(a == b == c for a, b, c in zip(words, words[1:], words[2:]))


def levels(n: int) -> Iterator[int]:
    """1, 2, 3, 4, 6, 8, 12, ... up to n."""
    step = 1
    while step <= n:
        yield step
        if step > 1 and step * 3 // 2 <= n:
            yield step * 3 // 2
        step *= 2


def speaking(text: str) -> Counter:
    """How many words of a text have each beginning; patterns it shows count 1, under names that start with a slash."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for k in range(SHORTEST, len(word) + 1):
            out[word[:k]] += n
    out.update(name for name, found in _FORMS.items() if found(text))
    return out


# ---- classifier ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Voters, the weights of their votes and of three totals, and a bias."""

    voters: list[Voter] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    bias: float = float(np.log(CLEAN / (1 - CLEAN)))

    def __post_init__(self):
        self.least = np.array([n for _, n in self.voters], np.int64)
        self.forms = [(k, _FORMS[s]) for k, (s, _) in enumerate(self.voters) if s.startswith("/")]
        stems = [(s.encode(), k) for k, (s, _) in enumerate(self.voters) if not s.startswith("/")]
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.tables = []  # by length in bytes: hashes of beginnings, in order, and their voters
        for size in sorted({len(s) for s, _ in stems}):
            own = [(s, k) for s, k in stems if len(s) == size]
            data = np.frombuffer(b"".join(s for s, _ in own), np.uint8)
            start = np.arange(len(own)) * size
            self.gate[self._first(data, start)] = True
            hashes = hashing.Ranges(data).of(start, start + size)
            order = np.argsort(hashes)
            self.tables.append((size, hashes[order], np.array([k for _, k in own], np.int64)[order]))

    @staticmethod
    def _first(data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A place in the gate for the first four bytes."""
        four = sum(data[start + i].astype(np.uint32) << np.uint32(8 * i) for i in range(SHORTEST))
        return (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - _GATE_BITS)

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (text, voter) that speak, and by text the totals: voters, words that begin so, their share of the words."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        edge = np.diff(_IS_LETTER[data].astype(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = np.diff(np.searchsorted(start, ends), prepend=0)
        long = np.flatnonzero(end - start >= SHORTEST)
        some = long[self.gate[self._first(data, start[long])]] if len(long) else long
        start, end = start[some], end[some]
        own = np.searchsorted(ends, start, "right")
        ranges = hashing.Ranges(data) if len(some) else None
        spoken, hit = [np.zeros(0, np.int64)], np.zeros(len(some), bool)
        for size, hashes, voters in self.tables if len(some) else ():
            at = np.flatnonzero(end - start >= size)
            found = ranges.of(start[at], start[at] + size)
            k = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            yes = hashes[k] == found
            hit[at[yes]] = True
            spoken.append(own[at[yes]] * len(self.voters) + voters[k[yes]])
        for k, form in self.forms:
            spoken.append(np.array([i * len(self.voters) + k for i, t in enumerate(texts) if form(t)], np.int64))
        pairs, times = np.unique(np.concatenate(spoken), return_counts=True)
        text, voter = np.divmod(pairs, max(1, len(self.voters)))
        loud = times >= self.least[voter]
        text, voter = text[loud], voter[loud]
        hits = np.bincount(own[hit], minlength=len(texts))
        totals = np.stack([np.log1p(np.bincount(text, minlength=len(texts))), np.log1p(hits), np.minimum(1.0, 10 * hits / np.maximum(1, words))], 1)
        return text, voter, totals

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for part in minhash.in_pieces(texts):
            text, voter, totals = self.votes(texts[part])
            n = len(self.voters)
            z = self.bias + np.bincount(text, self.weights[:n][voter], len(totals)) + totals @ self.weights[n:]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


# ---- label model -----------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Rates of speaking on the classes (0, 1) when the parent abstains and when it speaks; the parent of each voter (-1:
    none) and how much the two tell about each other within the classes; the share of the toxic class."""

    prior: float
    parent: np.ndarray
    correlation: np.ndarray
    alone: np.ndarray
    together: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        up = (votes[:, np.maximum(self.parent, 0)] > 0) & (self.parent >= 0)
        told = np.log(self.together[1] / self.together[0]) * up + np.log(self.alone[1] / self.alone[0]) * ~up
        z = np.log(self.prior / (1 - self.prior)) + (told * (votes > 0)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(worth: np.ndarray, least: float) -> np.ndarray:
    """The spanning tree of largest worth, as parents; a link worth less than `least` is no link."""
    n = len(worth)
    parent, best, via, inside = np.full(n, -1), worth[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.argmax(np.where(inside, -np.inf, best)))
        if best[j] > least:
            parent[j] = via[j]
        inside[j] = True
        closer = worth[j] > best
        best, via = np.where(closer, worth[j], best), np.where(closer, j, via)
    return parent


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float | None = None, rounds: int = 50) -> tuple[np.ndarray, LabelModel]:
    """Posterior of the toxic class for each row, from its votes alone, and the model.

    votes: rows by voters, 1 where a voter speaks. Expected counts under the posterior and counts over gold labels, as
    their prior, together give rates, correlations and tree; the rounds end when posteriors hold still. The rounds take the
    class share of these rows, as their counts do; the posterior that goes out takes `prior`, the share of all rows."""
    x = votes.astype(np.float64)
    n, voters = x.shape
    share, prior = (float(np.clip(p, 1e-4, 1 - 1e-4)) for p in (gold.mean(), gold.mean() if prior is None else prior))
    post = gold  # the first round's counts are those of the prior alone
    every = np.arange(voters)
    for _ in range(rounds):
        info, both, own, total = np.zeros((voters, voters)), [], [], []
        for weight in (2 - post - gold, post + gold):
            pairs = (x * weight[:, None]).T @ x
            size, single = weight.sum(), np.diag(pairs).copy()
            p11, p = (pairs + 0.125) / (size + 0.5), (single + 0.25) / (size + 0.5)
            a, b = p[:, None], p[None]
            for joint, expected in ((p11, a * b), (a - p11, a * (1 - b)), (b - p11, (1 - a) * b), (1 - a - b + p11, (1 - a) * (1 - b))):
                joint = np.maximum(joint, 1e-9)
                info += size / (2 * n) * joint * np.log(joint / expected)
            both.append(pairs)
            own.append(single)
            total.append(size)
        np.fill_diagonal(info, -np.inf)
        parent = _tree(info, 2.0 / n)
        up = np.maximum(parent, 0)
        alone, together = [], []
        for pairs, single, size in zip(both, own, total):
            rate = (single + 0.25) / (size + 0.5)
            shared = pairs[every, up]
            free = parent < 0
            together.append(np.clip(np.where(free, rate, (shared + 0.5 * rate) / (single[up] + 0.5)), 1e-4, 1 - 1e-4))
            alone.append(np.clip(np.where(free, rate, (single - shared + 0.5 * rate) / (size - single[up] + 0.5)), 1e-4, 1 - 1e-4))
        model = LabelModel(share, parent, np.where(parent < 0, 0.0, info[every, up]), np.stack(alone), np.stack(together))
        new = model.posterior(x)
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-3:
            break
    model.prior = prior
    return model.posterior(x), model


# ---- fit -------------------------------------------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Labelled rows to learn from: text, toxic, each pair once, from at most MAX_TOXIC + MAX_CLEAN labels, so broadcast;
    and the share of toxic ones among all labels that may be learnt from."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    counts = dict(own.groupBy("toxic").count().collect())
    first = lambda kind, n: own.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = {r.doc_id: r.toxic for r in first(0, MAX_CLEAN).union(first(1, MAX_TOXIC)).collect() if r.doc_id is not None}
    rows = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, toxic int")
    sample = common.texts(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"])
    return sample, counts.get(1, 0) / max(1, sum(counts.values()))


def likelihood_ratio(p: int, q: int, n1: int, n0: int) -> float:
    """Twice the log likelihood of p of n1 and q of n0 at two rates over that at one."""
    def log_like(k, n, rate):
        return (k * np.log(rate) if k else 0.0) + ((n - k) * np.log1p(-rate) if n > k else 0.0)

    one = (p + q) / (n1 + n0)
    return 2 * (log_like(p, n1, p / n1) + log_like(q, n0, q / n0) - log_like(p, n1, one) - log_like(q, n0, one))


def telling(counts: dict[Voter, tuple[int, int]], n1: int, n0: int) -> list[Voter]:
    """Of (beginning, count) with the rows of either class that have it, those that are worth a vote, the most telling
    first: for each beginning the count that tells most, and no beginning that a shorter one makes idle."""
    best: dict[str, tuple[float, int, float]] = {}
    for (stem, least), (p, q) in counts.items():
        if p / n1 > LIFT * q / n0 and (told := likelihood_ratio(p, q, n1, n0)) >= SIGNIFICANCE and (stem not in best or (told, -least) > (best[stem][0], -best[stem][1])):
            best[stem] = told, least, (p + 0.5) / (q + 0.5)
    idle = lambda stem, odds: any(odds <= BETTER * best[stem[:k]][2] for k in range(SHORTEST, len(stem)) if stem[:k] in best)
    return [(stem, least) for stem, (_, least, odds) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])) if not idle(stem, odds)]


def _mine(sample: DataFrame, n1: int, n0: int) -> list[Voter]:
    """The voters that the sample suggests. Counts are bounded by the sample's words."""

    def counted(kind, only=None):
        def rows(seen):
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen]), pa.array([k for _, k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["stem", "least", "n"])

        def run(batches):
            seen: Counter = Counter()
            for batch in batches:
                for text, toxic in zip(common.column(batch, "text"), common.column(batch, "toxic")):
                    if toxic != kind:
                        continue
                    seen.update((s, k) for s, n in speaking(text).items() if only is None or s in only for k in levels(n))
                    if len(seen) > _HELD:
                        yield rows(seen)
                        seen = Counter()
            if seen:
                yield rows(seen)

        return sample.mapInArrow(common.tidy(run), "stem string, least int, n long").groupBy("stem", "least").agg(F.sum("n").alias("n"))

    enough = next(p for p in range(1, n1 + 2) if p > n1 or likelihood_ratio(p, 0, n1, n0) >= SIGNIFICANCE)
    spoken = {(r.stem, r.least): r.n for r in counted(1).where(F.col("n") >= enough).collect()}
    other = {(r.stem, r.least): r.n for r in counted(0, {s for s, _ in spoken}).collect()} if spoken else {}
    return telling({v: (p, other.get(v, 0)) for v, p in spoken.items()}, n1, n0)


def apart(votes: np.ndarray) -> list[int]:
    """Of voters, the most telling first, those whose rows overlap little with those of every one before."""
    together = votes.T @ votes
    size = np.diag(together)
    overlap = together / np.maximum(size[:, None] + size[None] - together, 1)
    kept: list[int] = []
    for j in range(len(size)):
        if not kept or overlap[j, kept].max() < SAME:
            kept.append(j)
    return kept


def _votes(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, votes and totals of the sample's rows, in a fixed order."""

    def run(batches):
        schema = pa.schema([("toxic", pa.int32()), ("voters", pa.list_(pa.int32())), ("totals", pa.list_(pa.float64()))])
        for batch in batches:
            toxic, texts = common.column(batch, "toxic"), common.column(batch, "text")
            for part in minhash.in_pieces(texts):
                text, voter, totals = model.votes(texts[part])
                spoken = np.split(voter, np.searchsorted(text, np.arange(1, len(totals))))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[part], pa.int32()), pa.array([v.tolist() for v in spoken], schema.field(1).type), pa.array(totals.tolist(), schema.field(2).type)], schema=schema)

    rows = sorted(tuple(r) for r in sample.mapInArrow(common.tidy(run), "toxic int, voters array<int>, totals array<double>").collect())  # the sample's bound
    votes = np.zeros((len(rows), len(model.voters)), np.float32)
    for i, (_, spoken, _) in enumerate(rows):
        votes[i, spoken] = 1
    return np.array([r[0] for r in rows], np.float64), votes, np.array([r[2] for r in rows]).reshape(len(rows), 3)


def fit(docs: DataFrame, labels: DataFrame, families: tuple[str, ...] = ("lexicon", "patterns")) -> Model:
    """The classifier; `families` are the kinds of voters that may speak."""
    found, prior = _sample(docs, labels)
    sample = common.cut(found.repartition(16), "toxicity-sample")
    size = dict(sample.groupBy("toxic").count().collect())
    model = Model()
    if size.get(0) and size.get(1):
        wanted = [v for v in _mine(sample, size[1], size[0]) if ("patterns" if v[0].startswith("/") else "lexicon") in families]
        gold, votes, _ = _votes(sample, Model(wanted))
        voters = [wanted[j] for j in apart(votes)]
        if voters:
            gold, votes, totals = _votes(sample, Model(voters))
            post, _ = label_model(votes, gold, prior)
            model = Model(voters, *train_linear(np.hstack([votes, totals]), post))
    common.drop(sample)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            ids = common.column(batch, "doc_id")
            scores = model.scores(common.column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([is_held_out(i) for i in ids], pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return common.texts(docs).mapInArrow(common.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores([t or "" for t in common.column(batch, "text")]) < 0.5))

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(common.tidy(run), docs.schema)
