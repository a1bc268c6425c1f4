import hashlib
import re

import numpy as np
import pytest

from tidegrid.llm import urlfilter, warc
from tidegrid.llm.common import new_dir
from tidegrid.llm.urlfilter import judge
from tidegrid.llm.warc import arc_records, arc_to_warc, convert, parse_arc, read_warc, write_arc

PAGES = "page_id long, url string, html string, host string, path string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "p") for r in rows], PAGES)


def test_archives_round_trip(spark):
    big, other = "x\r\n\r\nWARC/1.0\r\n" * 120, "é" * 500
    rows = [(1, "http://a.example/1", big), (7, "http://b.example/ space\n", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "u", other), (10, "u", other), (None, "u", other), (7, "again", big), (12, "u", "y" * 200_000)]
    got = convert(_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["record_type"] in ("response", "revisit") and (r["refers_to"] is None) == (r["record_type"] == "response")
    expected = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows}
    sizes = {i: len((h or "").encode()) for i, _, h in rows}
    assert all(r["payload_digest"] == expected[r["page_id"]] and r["payload_bytes"] == sizes[r["page_id"]] for r in got)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got)
    assert [k for k in kinds if k[0] in (1, 3)] == [(1, "revisit", 7), (3, "revisit", 7)] and sorted(k[1] for k in kinds if k[0] == 7) == ["response", "revisit"]
    assert [k for k in kinds if k[0] in (-1, 9, 10)] == [(-1, "revisit", 10), (9, "revisit", 10), (10, "response", None)]
    assert {k[1] for k in kinds if k[0] in (4, 5, 6, 8, 12)} == {"response"}
    assert len({r["record_id"] for r in got}) == len(rows) and {r["target_uri"] for r in got if r["page_id"] == 3} == {"-"}
    assert convert(_frame(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_each_version(version):
    rows = [(1, "http://x/ y", b"ab\ncd"), (None, None, b"")]
    parsed = list(parse_arc(b"".join(arc_records(version, "n.arc", rows))))
    assert [h["URL"] for _, h, _ in parsed] == ["http://x/%20y", "-"] and len(parsed[0][1]) == (5 if version == 1 else 10)
    assert parsed[0][2].endswith(b"\r\n\r\nab\ncd") and parsed[0][1]["Archive-date"] == "20000101000001"
    data = b"".join(arc_records(version, "n.arc", rows))
    with pytest.raises(ValueError):
        list(parse_arc(data[:-20]))


def test_a_damaged_payload_is_an_error(spark, monkeypatch):
    folder = new_dir(spark, "damaged")
    files = arc_to_warc(write_arc(_frame(spark, [(1, "u", "z" * 5000)]), folder + "/arc"), folder + "/warc")
    from tidegrid.llm import warc

    path = files.first()["path"]
    data = warc._read(path).replace(b"zzzz", b"zzyz", 1)
    warc._write(path, [warc._gzip(data)])
    with pytest.raises(Exception, match="differs from its digest"):
        read_warc(files).collect()


def brute_judge(rows, rules, links, rounds=300, damping=0.85):
    split, rule_of = {}, {}
    for i, url, _ in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        split[i] = host, path
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule_of[i] = max(fit)[1:] if fit else (None, None)
    hosts = sorted({h for h, _ in split.values()} | {x for e in links for x in e})
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] += n

    def rank(verdict, w):
        seed = np.zeros(len(hosts))
        for i, (_, v) in rule_of.items():
            seed[at[split[i][0]]] += v == verdict
        seed = seed / max(1, seed.sum())
        out = w.sum(axis=1, keepdims=True)
        p = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
        score = (1 - damping) * seed
        for _ in range(rounds):
            score = (1 - damping) * seed + damping * score @ p
        return score

    trust, distrust = rank("allow", w), rank("block", w.T)
    return {i: (*split[i], rule_of[i][0], rule_of[i][1] or ("block" if distrust[at[split[i][0]]] > trust[at[split[i][0]]] else "allow")) for i, _, _ in rows}


def test_trust_follows_links(spark):
    gen = np.random.default_rng(3)
    hosts = ["good.org", "sub.good.org", "bad.example.org", "a.net", "b.net", "c.net", "d.net", "EXAMPLE.com", "x.com"]
    rows, links = [], {}
    for i in range(150):
        host = hosts[int(gen.integers(len(hosts)))]
        to = [hosts[int(k)] for k in gen.integers(0, len(hosts), 2)] if i % 3 else []
        html = "".join(f'<a class=x HREF = "http://{t}/p?q">t</a><a href="/local">l</a>' for t in to)
        rows.append((i, f"https://{host}/{['fr/', 'de/', 'es/', 'en/1', ''][int(gen.integers(5))]}z?x#y", html))
        for t in to:
            if t.lower() != host.lower():
                links[host.lower(), t.lower()] = links.get((host.lower(), t.lower()), 0) + 1
    rows += [(900, None, None), (901, "no scheme", "<a href='http://a.net'>"), (902, "http://com/fr/", ""), (903, "http://notcom/fr/", ""), (904, "x://com?/fr/", None), (905, "http://a.net:80/fr/", "")]
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(_frame(spark, rows), rules).collect()}
    assert got == brute_judge(rows, urlfilter.RULES, links)
    assert {v for *_, v in got.values()} == {"allow", "block"}
    assert judge(_frame(spark, []), rules).count() == 0


def _old_archive():
    """A version 1 archive as others wrote them: no gzip members of ours, no page ids, dates of 12 digits, other protocols."""
    about = b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
    page = b"HTTP/1.0 200 Document follows\nDate: Mon, 04 Nov 1996 14:21:06 GMT\nX-Page-Id: none\n\n<HTML>\nHello \xe9 World"
    no_head = b"HTTP/1.0 200 OK without an end"
    parts = [(b"filedesc://IA-000001.arc 0.0.0.0 19960923142103 text/plain", about), (b"http://www.dryswamp.edu:80/index.html 127.10.100.2 199611041421 text/html; charset=utf-8", page), (b"dns:www.dryswamp.edu 127.10.100.2 19961104142103 text/dns", b"19961104142103\nwww.dryswamp.edu. 300 IN A 127.10.100.2\n"), (b"http://x/a b c 1.2.3.4 99999999999999 no-type", no_head), (b"ftp://x/empty 1.2.3.4 19961104142103 -", b"")]
    return b"\n".join(head + b" " + str(len(block)).encode() + b"\n" + block for head, block in parts) + b"\n", parts[1:]


def test_archives_of_other_writers(spark):
    import gzip

    from tidegrid.llm import warc

    data, parts = _old_archive()
    assert [block for _, _, block in parse_arc(data)] == [b for _, b in parts] and [h["URL"] for _, h, _ in parse_arc(data)] == ["http://www.dryswamp.edu:80/index.html", "dns:www.dryswamp.edu", "http://x/a b c", "ftp://x/empty"]
    v2 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 a.arc 122\n" + b"2 0 Alexa Internet\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n" + b"\n\nhttp://y/ 1.2.3.4 19961104142103 text/html; a=b 200 abc - 150 a.arc 5\nhello\n"
    assert [(h["Content-type"], b) for _, h, b in parse_arc(v2)] == [("text/html; a=b", b"hello")]
    folder = new_dir(spark, "old")
    warc._write(f"{folder}/in/a.arc.gz", [gzip.compress(data)])
    warc._write(f"{folder}/in/b.arc.gz", [gzip.compress(v2[:200]), gzip.compress(v2[200:])])
    files = spark.createDataFrame([(f"{folder}/in/a.arc.gz",), (f"{folder}/in/b.arc.gz",)], "path string")
    rows = {r["target_uri"]: r for r in read_warc(arc_to_warc(files, f"{folder}/out")).collect()}
    assert {u: r["record_type"] for u, r in rows.items()} == {"http://www.dryswamp.edu:80/index.html": "response", "dns:www.dryswamp.edu": "resource", "http://x/a b c": "resource", "ftp://x/empty": "resource", "http://y/": "resource"}
    assert rows["http://www.dryswamp.edu:80/index.html"]["warc_date"] == "1996-11-04T14:21:00Z" and rows["http://x/a b c"]["warc_date"] == "1970-01-01T00:00:00Z"
    assert rows["http://www.dryswamp.edu:80/index.html"]["payload_digest"] == hashlib.sha1(b"<HTML>\nHello \xe9 World").hexdigest() and all(r["page_id"] is None for r in rows.values())


def test_scores_settle(spark):
    """Two hosts whose scores nearly balance after a few rounds only: a long chain of links carries the rest."""
    rows = [(0, "http://good.org/x", "<a href='http://h0.net/'>"), (1, "http://x.com/de/x", "")]
    rows += [(10 + i, f"http://h{i}.net/", f"<a href='http://h{i + 1}.net/'>") for i in range(45)]
    rows += [(99, "http://h45.net/", "<a href='http://x.com/'>")]
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    out = {r["page_id"]: r for r in judge(_frame(spark, rows), rules).collect()}
    assert abs(out[99]["trust"] - 0.15 * 0.85**46) < 1e-6 and abs(out[10]["distrust"] - 0.15 * 0.85**46) < 1e-6 and out[99]["trust"] > 0
    with pytest.raises(ValueError):
        judge(_frame(spark, rows), rules, damping=1.0)


def test_plain_broken_and_cut_off_archives(spark):
    import gzip

    rows = [(i, f"http://x/{i}", f"page {i} ".encode() * 300) for i in range(5)]
    folder = new_dir(spark, "odd")
    records = list(arc_records(1, "a", rows))
    data = b"".join(records)
    junk = b"this is no header line\nnor this\n"
    files = {
        "plain.arc": data, "packed.arc.gz": gzip.compress(data), "members.arc.gz": b"".join(map(gzip.compress, records)), "junk.arc": b"".join([*records[:3], junk, *records[3:]]),
        "cut.arc": data[:-700], "cut.arc.gz": b"".join(map(gzip.compress, records))[:-40], "version.arc": data.replace(b"1 0 tidegrid", b"7 0 tidegrid", 1), "none.arc": b"", "other.arc": b"<html>\n" * 3,
    }
    for name, raw in files.items():
        warc._write(f"{folder}/{name}", [raw])
    paths = spark.createDataFrame([(f"{folder}/{n}",) for n in files], "path string")
    broken = {}
    for r in warc.broken_records(paths).collect():
        broken.setdefault(r["path"].rpartition("/")[2], []).append((r["offset"], r["fault"]))
    at = sum(map(len, records[:3]))
    assert sorted(broken) == ["cut.arc", "cut.arc.gz", "junk.arc", "other.arc", "version.arc"] and all(len(v) == 1 for v in broken.values())
    assert broken["junk.arc"][0][0] == at and "not a header line" in broken["junk.arc"][0][1] and "within a member" in broken["cut.arc.gz"][0][1] and "7" in broken["version.arc"][0][1]
    back = read_warc(arc_to_warc(paths, f"{folder}/out")).collect()
    assert len(back) == 4 * 5 + 2 * 4 and sum(r["record_type"] == "response" for r in back) == 5
    one = warc.Archive(gzip.compress(b"a" * 100_000 + b"\n") + gzip.compress(b"bc"))
    assert one.line(1 << 20) == b"a" * 100_000 + b"\n" and one.take(2) == b"bc" and one.line() == b"" and one.at == 100_003
