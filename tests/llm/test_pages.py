"""WARC and URL filters."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib

import duckdb
import pytest

from granary.llm import urlfilter, warc
from granary.llm.common import scratch, staged
from granary.llm.queries import ORACLE_SQL, RULES, op9_warc

BIG = "<p>é</p>" * 50


def test_round_trip(spark):
    rows = [(5, "http://a/", BIG), (3, "http://b/\n", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", BIG), (3, "u", BIG), (11, "long", BIG * 3000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, refers_to int, digest string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == BIG and i != 3
        want.append((i or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_query_gives_what_its_sql_gives(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.sql(ORACLE_SQL["op9_warc"])
    got = op9_warc(spark, folder)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert [str(t) for t in want.types] == ["BIGINT", "BIGINT", "VARCHAR", "VARCHAR", "BIGINT"]


def test_read_payloads(spark):
    pages = spark.createDataFrame([(1, "http://x/é", BIG), (2, "b", BIG)], "page_id long, url string, html string")
    back = {r.page_id: r for r in warc.read(staged(warc.write(pages, scratch(spark, "warc")), "archives"), payloads=True).collect()}
    assert bytes(back[1].payload).decode() == BIG and back[1].url == "http://x/é" and back[1].payload_bytes == len(BIG.encode())
    assert back[2].payload is None and back[2].payload_bytes is None and back[2].refers_to_record == back[1].record_id


@pytest.mark.parametrize("url", ["http://a/b?c=d e", "", " x", "a\r\nWARC-Type: x", '"q"', "é\u2028", "null"])
def test_urls_survive(url):
    found = next(warc.records(io.BytesIO(warc.record(1, url, b"p", None, 1)))).headers["WARC-Target-URI"]
    assert (json.loads(found) if found[0] == '"' else found) == url


def archive(*payloads):
    return b"".join(warc.record(i, "u", p, None, 6) for i, p in enumerate(payloads))


def test_reader_frames_records_in_small_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    data = archive(b"one", b"", b"two\r\n\r\nWARC/1.1\r\n" * 9)
    assert [r.payload for r in warc.records(io.BytesIO(data))] == [b"one", b"", b"two\r\n\r\nWARC/1.1\r\n" * 9]
    assert list(warc.records(io.BytesIO(b""))) == []


def test_reader_rejects_damage():
    data = archive(b"one", b"payload " * 40)
    for cut in (1, 9, len(archive(b"one")) + 5):
        with pytest.raises(warc.BadRecord, match="ends within"):
            list(warc.records(io.BytesIO(data[: len(data) - cut] if cut < 10 else data[:cut])))
    plain = zlib.decompress(archive(b"payload " * 40), 31)
    for wrong in (plain.replace(b"payload payload", b"payload PAYLOAD", 1), plain.replace(b"Content-Length: 4", b"Content-Length: 3", 1), plain.replace(b"Content-Length: 4", b"Content-Length: 5", 1), plain[4:], plain + b"x", plain.replace(b"Content-Length: 4", b"Content-Length: x4", 1)):
        with pytest.raises(warc.BadRecord):
            list(warc.records(io.BytesIO(gzip.compress(wrong))))
    for broken in (data[:40] + b"\xff\xff\xff" + data[43:], b"not gzip"):
        with pytest.raises(warc.BadRecord):
            list(warc.records(io.BytesIO(broken)))


def foreign(head, block):
    return gzip.compress(b"\r\n".join([b"WARC/1.0", *head, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n")


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_records_of_other_writers(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<html>" + b"x" * 300
    sha1 = base64.b32encode(hashlib.sha1(block).digest())
    md5 = base64.b64encode(hashlib.md5(b"<html>" + b"x" * 300).digest())
    data = foreign([b"WARC-Type:warcinfo", b"Content-Type: application/warc-fields"], b"software: other\r\n")
    data += foreign([b"warc-type: response", b"WARC-Target-URI:http://x/", b"Content-type: application/http;msgtype=response", b"WARC-Block-Digest: sha1:" + sha1, b"WARC-Payload-Digest: md5:" + md5, b"WARC-Folded: one", b"  two"], block)
    data += foreign([b"WARC-Type: resource", b"WARC-Block-Digest: unheard-of:abc"], b"")
    info, page, empty = warc.records(io.BytesIO(data))
    assert (info.kind, info.payload) == ("warcinfo", b"software: other\r\n")
    assert page.payload == block.partition(b"\r\n\r\n")[2] and page.headers["WARC-Target-uri"] == "http://x/" and page.headers.get("WARC-FOLDED") == "one two"
    assert empty.payload == b"" and empty.headers.get("none") is None
    with pytest.raises(warc.BadRecord, match="block digest"):
        list(warc.records(io.BytesIO(foreign([b"WARC-Block-Digest: sha1:" + sha1], block[:-1] + b"y"))))


def stored(spark, tmp_path, *members):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    return staged(warc.read(spark.createDataFrame([(f"file://{path}",)], "archive string")), "records")


def test_revisits_are_resolved_and_sizes_are_measured(spark, tmp_path):
    first = foreign([b"WARC-Type: response", b"X-Payload-Length: 999", b"X-Page-ID: 4", b"WARC-Record-ID: <urn:a>"], b"p" * 200)
    digest = hashlib.sha256(b"p" * 200).hexdigest()
    again = [b"WARC-Type: revisit", b"X-Page-ID: 6", b"WARC-Refers-To: <urn:a>"]
    got = warc.resolved(stored(spark, tmp_path, first, foreign([*again, b"WARC-Payload-Digest: sha256:" + digest.encode()], b""))).collect()
    assert sorted(map(tuple, got)) == [(4, 200, digest, "response", None), (6, 200, digest, "revisit", 4)]
    for wrong in ([*again, b"WARC-Payload-Digest: sha256:" + b"0" * 64], [*again[:2], b"WARC-Refers-To: <urn:b>"], again[:2]):
        with pytest.raises(Exception, match="does not have the payload"):
            warc.resolved(stored(spark, tmp_path, first, foreign(wrong, b""))).collect()


URLS = [
    ("http://Sub.Example.NET/en/1?x", "sub.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
    ("x://ÄB.org/fr/#top", "Äb.org", "/fr/", "org/fr/", "allow"),
    ("a://b.org/c://d", "b.org", "/c://d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: tuple(r)[1:5] for r in urlfilter.judge(pages, labels, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urlfilter.judge(pages.limit(0), labels, RULES).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rows, marks = [], []

    def add(url, n, bad, every=1):
        for k in range(n):
            i = len(rows)
            rows.append((i, url.replace("{}", str(k))))
            if k % every == 0:
                marks.append((i, bad))

    add("http://good.org/news/{}", 200, 0)
    add("http://good.org/spam/{}.html", 200, 1, every=2)  # rejected as well where it has no label
    add("http://good.org/a{}b/x", 60, 0)
    add("http://bad.org/deep/er/{}/and/more/of/it/{}", 80, 1)
    add("http://new.org/{}", 30, 0)
    marks += [(0, None), (None, 1), (1, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, spark.createDataFrame(marks, "page_id long, bad int"), []).collect()}
    for i, url in rows:
        assert got[i] == ("block" if "/spam/" in url or "bad.org" in url else "allow"), url


def test_many_values_become_a_wildcard(spark):
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(60)]
    rows = [(i, f"http://h.org/{w}/in") for i, w in enumerate(words)] + [(100 + i, "http://h.org/fine/out") for i in range(40)]
    marks = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, spark.createDataFrame(marks, "page_id long, bad int"), []).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[100 + i] for i in range(40)} == {"allow"}


@pytest.mark.parametrize("sections", [3, 21, 300])
def test_a_bad_section_is_found_among_any_number(spark, sections):
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(sections)]
    pages = spark.createDataFrame([(100 * i + k, f"http://h.org/{w}/{k}") for i, w in enumerate(names) for k in range(100)], "page_id long, url string")
    marks = pages.select("page_id", (pages.page_id >= 100 * (sections - 1)).cast("int").alias("bad"))
    got = urlfilter.judge(pages, marks, []).filter("verdict = 'block'").collect()
    assert {r.page_id for r in got} == set(range(100 * (sections - 1), 100 * sections))


def test_rare_segments_are_judged_together_beside_a_large_one(spark):
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(60)]
    rows = [(i, f"http://h.org/{w}/in") for i, w in enumerate(words)] + [(100 + i, "http://h.org/fine/out") for i in range(400)]
    marks = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urlfilter.judge(pages, spark.createDataFrame(marks, "page_id long, bad int"), []).filter("verdict = 'block'").collect()
    assert {r.page_id for r in got} == set(range(60))


def brute_tree(rows, marks, tree=urlfilter.Tree()):
    """Verdicts by the same rules, node by node in plain Python."""
    bad = {}
    for i, b in marks:
        bad[i] = max(b, bad.get(i, 0))
    kinds, of = {}, {}
    for i, url in rows:
        host, path = url.split("://", 1)[1].split("/", 1)
        parts = [x for x in re.sub("[0-9]+", "#", path).split("/") if x]
        parts = [*parts[: tree.depth - 1], *["/".join(parts[tree.depth - 1 :])] * (len(parts) >= tree.depth)]
        kind = of[i] = host, *parts, *[""] * (tree.depth - len(parts))
        n, b = kinds.get(kind, (0, 0))
        kinds[kind] = (n + (i in bad), b + bad.get(i, 0))
    m = tree.smoothing
    total = [sum(x[k] for x in kinds.values()) for k in (0, 1)]
    prior = total[1] / total[0] if total[0] else 0.0
    share = {}
    for host in {k[0] for k in kinds}:
        n, b = (sum(x[j] for k, x in kinds.items() if k[0] == host) for j in (0, 1))
        share[host] = (b + m * prior) / (n + m)
    good = lambda host, b, n: 1 - (b + m * share[host]) / (n + m)
    named = {k: k for k in kinds}
    for level in range(1, tree.depth + 1):
        count = {}
        for k in kinds:
            for at in (named[k][:level], named[k][: level + 1]):
                n, b = count.get(at, (0, 0))
                count[at] = (n + kinds[k][0], b + kinds[k][1])
        for k in kinds:
            own = named[k]
            (pn, pb), (bn, bb) = count[own[:level]], count[own[: level + 1]]
            alike = not pn or not bn or abs(bb / bn - pb / pn) <= tree.alike * math.sqrt(pb / pn * (1 - pb / pn) / bn)
            rare = (good(k[0], bn, bn) < tree.purity) == (good(k[0], 0, bn) < tree.purity)
            if own[level] and (alike or rare):
                named[k] = (*own[:level], "*", *own[level + 1 :])
    leaf = {}
    for k in kinds:
        n, b = leaf.get(named[k], (0, 0))
        leaf[named[k]] = (n + kinds[k][0], b + kinds[k][1])
    purity = {k: good(k[0], leaf[named[k]][1], leaf[named[k]][0]) for k in kinds}
    return {i: ("block" if purity[k] < tree.purity else "allow", purity[k]) for i, k in of.items()}


@pytest.mark.parametrize("seed", range(4))
def test_tree_by_brute_force(spark, seed):
    random.seed(seed)
    rows, marks = [], []
    for host in range(3):
        rates = {w: random.choice([0, 0.05, 0.5, 0.9, 1]) for w in [f"s{chr(97 + i)}" for i in range(random.choice([3, 30]))]}
        for w, rate in rates.items():
            for k in range(random.choice([1, 3, 40, 120])):
                deep = "/".join(random.choice(["x", "y", "9z", "w"]) for _ in range(random.randrange(0, 8)))
                i = len(rows)
                rows.append((i, f"http://h{host}.org/{w}/{deep}"))
                if random.random() < 0.7:
                    marks.append((i, int(random.random() < rate)))
    rows.append((len(rows), "http://h0.org/" + "very/long" * 4000))
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string")
    got = urlfilter.judge(pages, spark.createDataFrame(marks, "page_id long, bad int"), []).collect()
    want = brute_tree(rows + rows[:3], marks)
    assert len(got) == len(rows) + 3 and {r.verdict for r in got} == {"block", "allow"}
    for r in got:
        assert (r.verdict, r.purity) == (want[r.page_id][0], pytest.approx(want[r.page_id][1]))
