import io
import random

import pytest

from plinth.llm import archives, common, queries, urlfilter
from tests import compare

PAGES = [
    (5, "http://a.org/x y", "<p>same</p>"), (2, "https://b.com/", "<p>same</p>"), (9, None, ""), (3, "", None), (7, "HTTP://C.org", "line\r\n\r\nbreak\n"),
    (8, "http://d.net/é?q", "<p>é漢</p>" * 3000), (None, "http://n", "<p>same</p>"), (None, "http://n", "only"), (2, "https://b.com/", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")


def converted(spark, pages, **options):
    arcs = archives.write_arcs(pages, common.scratch(spark, "test-arc"))
    return archives.read_pages(spark, archives.convert(spark, arcs, common.scratch(spark, "test-warc"), **options))


def test_round_trip(spark, pages):
    rows = converted(spark, pages.repartition(4)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in rows if r.page_id is not None) == sorted(
        (i, len((h or "").encode()), archives.base32_sha1((h or "").encode())) for i, _, h in PAGES if i is not None
    )
    kinds = {}
    for r in rows:
        kinds.setdefault(r.payload_digest, []).append((r.record_type, r.page_id, r.refers_to))
    for found in kinds.values():
        assert sum(k == "response" for k, _, _ in found) == 1
    same = kinds[archives.base32_sha1(b"<p>same</p>")]
    assert sorted(same, key=repr) == sorted([("response", 2, None), ("revisit", 2, 2), ("revisit", 5, 2), ("revisit", None, 2)], key=repr)
    empty = kinds[archives.base32_sha1(b"")]
    assert sorted(empty) == [("response", 3, None), ("revisit", 9, 3)]
    assert len({r.record_id for r in rows}) == len(PAGES)


def test_small_payloads_can_be_left_alone(spark, pages):
    rows = converted(spark, pages, min_bytes=12).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_no_pages(spark, pages):
    assert converted(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_by_declared_length(version):
    fields = {"URL": "http://x/a b", "IP-address": "1.2.3.4", "Archive-date": "20200102030405", "Content-type": "text/plain", "Result-code": "200"}
    data = archives.version_block(version, "f.arc") + archives.arc_bytes(version, fields, b"one\n\ntwo\n") + b"\n" + archives.arc_bytes(version, fields, b"")
    found = list(archives.read_arc(io.BytesIO(data)))
    assert [r.content for r in found] == [b"one\n\ntwo\n", b""] and {r.version for r in found} == {version}
    assert found[0].fields["URL"] == "http://x/a%20b" and archives.iso_date(found[0].fields["Archive-date"]) == "2020-01-02T03:04:05Z"
    spaced = archives.version_block(version, "f.arc") + archives.arc_bytes(version, fields, b"x").replace(b"a%20b", b"a b")
    assert next(archives.read_arc(io.BytesIO(spaced))).fields["URL"] == "http://x/a b"


@pytest.mark.parametrize("data", [b"http://x 1.1.1.1 2020 text/plain 3\nabc\n", archives.version_block(1, "f") + b"http://x 1.1.1.1 2020 text/plain 9\nabc\n", archives.version_block(1, "f") + b"too few 3\nabc\n"])
def test_malformed_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data)))


def test_resources_keep_their_type():
    record = archives.ArcRecord(1, {"URL": "dns:x", "IP-address": "1.1.1.1", "Archive-date": "20200101", "Content-type": "text/dns"}, b"record")
    ((headers, block),) = archives.read_warc(io.BytesIO(archives.warc_of(record, ["a"], {"file": 0, "seq": 0, "revisit": False, "digest": archives.base32_sha1(b"record")})))
    assert (headers["warc-type"], headers["content-type"], block) == ("resource", "text/dns", b"record")


# ---- URL rules -------------------------------------------------------------------------------------------------------


def brute_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(x in host + path for x in ("spam", "casino")) else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(7)
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "x://org", "x://org?/", "x://a.org/y", "x://aorg/y", "x://b.com/x.org/", "a://b://org/", "http://example.org/en/1", "http://Sub.Example.ORG/es/a?b#c", "http://é.org/", "http://x.com/de/" + "z" * 50_000, "http://a\n.org/\n", "x://my-casino.net/?a"]
    urls += ["".join(rng.choice(["http://", "://", "/", "?", "#", "org", "com", ".", "example", "en/1", "/es/", "/fr/", "/de/", "spam", "A"]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df).collect()}
    assert got == {k: brute_judge(u) for k, u in enumerate(urls)}
    assert urlfilter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("glob,yes,no", [("a*b", ["ab", "axxb", "ab" * 50], ["a", "ba", "abc"]), ("*", ["", "x"], []), ("a?c*", ["abc", "axcd"], ["ac", "abd"]), ("*.x/*", ["a.x/", "..x/y"], ["ax/"])])
def test_globs(glob, yes, no):
    automaton = urlfilter.Automaton([(0, urlfilter.glob_tokens("zz" * 40)), (1, urlfilter.glob_tokens(glob))])
    assert automaton.words > 1
    hits = automaton.matches([s.encode() for s in [*yes, *no]])[:, 1]
    assert hits.tolist() == [True] * len(yes) + [False] * len(no)


def test_queries(spark, sf_dir):
    con = compare.connect(sf_dir)
    assert compare.differences(spark, con, "op6", queries.op6_url_automaton, queries.ORACLES["op6_url_automaton"], sf_dir) is None
    rows = queries.op3_arc_to_warc(spark, sf_dir).collect()
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i], i)
    want = sorted((i, len(b), archives.base32_sha1(b), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in html.items())
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
