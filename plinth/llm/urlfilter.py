"""URL filter: all wildcard rules run at once over each canonical URL as one bit-parallel automaton.

A canonical URL is its lower-cased host followed by its path. Every glob is a run of bits in multiword masks: bit i of
a run says that i tokens are matched. Reading a byte shifts the words by one and keeps the bits whose token takes the
byte (Shift-And); bits in front of a wildcard also keep themselves. A batch of URLs advances together, a byte a step,
and ends as soon as no bit can change.

Defined cases: a null URL, or one without `://`, has an empty host and path and gets the default verdict unless a glob
takes the empty string; repeated rows are judged each; of rules that fit the longest wins, then the first; URLs are
judged whole; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import common

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What the method itself judges where no rule fits: globs over the canonical URL, `*` for any run, `?` for any byte.
GLOBS = (("block", "*spam*"), ("block", "*casino*"))
DEFAULT_VERDICT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ANY, _NO_SLASH = "any", "no slash"  # wildcards that loop


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_tokens(host: str, path: str) -> list[list]:
    """Token lists for a host with all its subdomains and a path prefix; an empty path takes any path."""
    tails = [[*path.encode(), _ANY]] if path else [[], [ord("/"), _ANY]]
    return [[*front, *host.encode(), *tail] for front in ([], [_NO_SLASH, ord(".")]) for tail in tails]


def glob_tokens(glob: str) -> list:
    return [_ANY if b == ord("*") else None if b == ord("?") else b for b in glob.encode()]


class Automaton:
    """patterns: (group, tokens); matches() says for each URL and group whether one of its patterns takes the URL."""

    def __init__(self, patterns: Sequence[tuple[int, list]]):
        self.groups = 1 + max((g for g, _ in patterns), default=-1)
        bits, start, final, takes, loops = 0, [], [], [], []
        for group, toks in patterns:
            start.append(bits)
            for t in toks:
                if t in (_ANY, _NO_SLASH):
                    loops.append((bits, t))
                else:
                    bits += 1
                    takes.append((bits, t))
            final.append((group, bits))
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.take, self.loop = np.zeros((2, 256, self.words), np.uint64)  # by byte
        self.first = self._mask(start)
        for bit, t in takes:
            rows = slice(None) if t is None else t
            self.take[rows] = self.take[rows] | self._mask([bit])
        for bit, t in loops:
            self.loop |= self._mask([bit])
            if t == _NO_SLASH:
                self.loop[ord("/")] = self.loop[ord("/")] & ~self._mask([bit])
        self.absorbing = np.bitwise_and.reduce(self.loop) & self._mask([b for _, b in final])
        self.final = np.array([self._mask([b for g, b in final if g == k]) for k in range(self.groups)]).reshape(self.groups, self.words)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = [0] * self.words
        for b in bits:
            out[b // 64] |= 1 << b % 64
        return np.array(out, np.uint64)

    def matches(self, urls: Sequence[bytes]) -> np.ndarray:
        n = len(urls)
        size = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        state = np.tile(self.first, (n, 1))
        alive = n
        for j in range(int(size[0]) if n else 0):
            alive = int(np.searchsorted(-size[:alive], -j, "left"))  # URLs longer than j
            s = state[:alive]
            byte = data[at[:alive] + j]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:alive] = moved & self.take[byte] | s & self.loop[byte]
            if j % 8 == 7 and not (state[:alive] & ~self.absorbing).any():
                break
        out = np.empty((n, self.groups), bool)
        out[order] = ((state[:, None, :] & self.final[None]) != 0).any(2)
        return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    patterns = [(k, toks) for k, (_, host, path) in enumerate(ranked) for toks in rule_tokens(host, path)]
    patterns += [(len(ranked) + k, glob_tokens(g)) for k, (_, g) in enumerate(globs)]
    names = [h + p for _, h, p in ranked] + [None] * len(globs)
    verdicts = [v for v, _, _ in ranked] + [v for v, _ in globs]

    def run(batches):
        automaton = Automaton(patterns)
        for batch in batches:
            host, path = common.column(batch, "host"), common.column(batch, "path")
            hit = automaton.matches([(h + p).encode() for h, p in zip(host, path)])
            which = np.where(hit.any(1), hit.argmax(1), -1).tolist() if automaton.groups else [-1] * len(host)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("page_id")), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array([names[k] if k >= 0 else None for k in which], pa.string()), pa.array([verdicts[k] if k >= 0 else default for k in which], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    url = F.col("url")
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(common.tidy(run), "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT u.page_id, u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS k
    FROM u LEFT JOIN r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN contains(host || path, 'spam') OR contains(host || path, 'casino') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""
