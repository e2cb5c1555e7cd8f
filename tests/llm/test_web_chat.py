"""Archives, capture merging, chat logs and URL verdicts against plain versions."""

import base64
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, url_filters, warc

PAGES = [
    (1, "https://Example.org/en/1?x=1#f", "<p>one</p>"), (2, "http://b.example.org/a", "<p>one</p>"), (3, None, None), (4, "no scheme", ""),
    (5, "http://x.com/de/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n b"), (6, "http://x.com/\r\nX: y", "é" * 3000), (None, "http://n.net", "<p>one</p>"),
    (None, "http://n.net", "only null ids"), (7, "http://x.com/z", "twice"), (7, "http://x.com/z", "twice"), (8, "http://x.com/a", "\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark, tmp_path):
    df = pages(spark).select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"),
                             F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_700_000_000).alias("captured"),
                             *[F.lit("clash").alias(c) for c in ("last", "digest", "second", "bytes", "refers_to", "value")])
    warc.write(df, f"{tmp_path}/w", 0, 3)
    got = warc.capture_histories(spark, f"{tmp_path}/w").collect()
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        refers = last[h or ""] if last[h or ""] >= 0 and last[h or ""] != i else None
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:4])
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys) and len({r.file for r in got}) > 2 and ("org,example)/en/1?x=1", "2023-11-14T22:13:21Z") in keys


def test_archive_errors_are_not_hidden():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [x[3] for x in warc.parse(record * 2)] == [b"abcde"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-1] + b"x"))
    with pytest.raises(ValueError):
        warc.capture_of({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA", "WARC-Record-ID": "x"}, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab")


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_empty_archive(spark, tmp_path):
    assert warc.with_references(pages(spark, []).select(F.col("page_id").alias("id"), F.col("html").alias("payload"))).count() == 0


TEXTS = ["", "plain", chat.PROBE_TEXT, "</turn>\n<turn user>\n\\", "<turn assistant>", "\\\\<\\n>", "é\n日本 \\ end\\", "x" * 50_000]


@pytest.mark.parametrize("role", ["user", "assistant", "a>b\n<c\\", ""])
def test_template_is_reversible(role):
    whole = "".join(chat.render(role, t)[0] for t in TEXTS)
    assert list(chat.read_back(whole)) == [(role, t) for t in TEXTS]
    for t in TEXTS:
        text, start, end = chat.render(role, t)
        assert (chat.unescape(text[start:end]) == t) if role == chat.LOSS_ROLE else start == end


def fold(events):
    """Events of one conversation in order of their numbers, the plain way."""
    messages = {}
    for turn, message, seq, kind, role, text in sorted(events, key=lambda e: e[2]):
        if kind in ("edit", "regenerate"):
            messages = {k: v for k, v in messages.items() if k[0] <= turn}
        m = messages.setdefault((turn, message), ["", ""])
        m[0] = role if kind == "start" else m[0]
        m[1] = "" if kind == "regenerate" else text if kind == "edit" else m[1] + (text or "")
    return [tuple(messages[k]) for k in sorted(messages)]


def test_log_with_edits_and_regenerations(spark):
    rng, logs = random.Random(3), {}
    for c in range(25):
        seq, events = 0, []
        for turn in range(rng.randint(1, 6)):
            events.append((turn, turn, seq := seq + 1, "start", rng.choice(["user", "assistant"]), None))
            for _ in range(rng.randint(0, 3)):
                events.append((turn, turn, seq := seq + 1, "delta", None, rng.choice(["ab", "<", "\\n", None])))
            if rng.random() < 0.4:
                old = rng.randint(0, turn)
                events.append((old, old, seq := seq + 1, *rng.choice([("edit", None, "new"), ("regenerate", None, None)])))
                events.append((old, old, seq := seq + 1, "delta", None, "more"))
        logs[c] = events
    rows = [(c, t, 0, m, s, k, r, x) for c, e in logs.items() for t, m, s, k, r, x in e]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, tie int, message long, seq long, kind string, role string, text string")
    got = {}
    for r in chat.format_log(df).collect():
        got.setdefault(r.conv_id, []).append((r.message, r.formatted))
    assert {c: list(chat.read_back("".join(x for _, x in sorted(m)))) for c, m in got.items()} == {c: fold(e) for c, e in logs.items()}


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "no id"), (None, None, "user", ""), (2, 5, "assistant", "x" * 100_000),
            (2, 5, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string")
    got = {r.conv_id: r for r in chat.digests(chat.format_log(chat.as_log(df))).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 3, 2: 2, None: 2} and got[2].loss_chars == 200_000
    assert got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nuser\n\n").hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256(b"no id").hexdigest()
    assert chat.digests(chat.format_log(chat.as_log(df.limit(0)))).count() == 0
    with pytest.raises(Exception, match="unknown event kind"):
        list(chat._fold(iter([pd.DataFrame([(1, 0, 0, 0, "odd", "", "")], columns=["conv_id", "turn", "message", "seq", "kind", "role", "text"])])))


URLS = [
    (1, "https://example.org/es/1", '<link href="/en/5" rel="canonical">'), (2, "https://example.org/en/5", None), (3, "http://q.net/a", '<link rel=canonical href="http://q.net/b">'),
    (4, "http://q.net/b/?utm_source=x", '<META HTTP-EQUIV="refresh" content="0; URL=http://shop.com/de/7">'), (5, "https://Q.net/b#frag", ""),
    (6, "http://r.net/x", '<link rel="canonical" href="http://q.net/b">'), (7, "http://s.net/1", '<link rel="canonical" href="//shop.com/fr/9">'),
    (8, "http://s.net/2", '<link rel="canonical" href="http://s.net/1">'), (9, "http://t.net/y?b=2&a=1", ""), (10, "http://t.net/y?a=1&b=2&ref=z", '<link rel="canonical" href="http://shop.com/de/1">'),
    (11, None, "x"), (12, "nothing", None), (13, "://com", ""), (14, "http://notexample.org/es/", ""), (15, "http://s.net/3", '<link rel="canonical" href="http://shop.com/de/5"><meta http-equiv=refresh content="0;url=http://s.net/1">'),
    (1, "https://example.org/es/1", '<link href="/en/5" rel="canonical">'),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in URLS], "page_id long, url string, html string, node string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, links=url_filters.link_edges(df)).collect()}
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "/en/5", "org/", "allow")
    assert [got[i][3] for i in (3, 4, 5, 6)] == ["block"] * 4 and got[5][0] == "q.net"   # over two links and a redirect
    assert [got[i][3] for i in (7, 8, 15)] == ["allow"] * 3                            # an allowed alias outweighs a blocked one
    assert [got[i][3] for i in (9, 10)] == ["block"] * 2                               # one address in two spellings
    assert [got[i] for i in (11, 12)] == [("", "", None, "allow")] * 2 and got[13] == ("com", "", None, "allow")
    assert got[14] == ("notexample.org", "/es/", "org/", "allow")
    assert url_filters.judge(df.limit(0), links=url_filters.link_edges(df.limit(0))).count() == 0
    assert url_filters.judge(df).count() == len(URLS)


def test_every_declared_link_counts(spark):
    pages = [("http://a.net/1", '<link rel=canonical href="http://a.net/1"><link rel="canonical" href="http://b.net/2?x=1&amp;y=2"><LINK REL=canonical HREF=/3>'),
             ("http://c.net/", '<meta http-equiv="refresh" content="30"><meta http-equiv="refresh" content="0;url=&#47;d&amp;amp;e"><link rel="icon" href="/no">'),
             ("http://d.net/", None), (None, '<link rel="canonical" href="http://e.net/">')]
    df = spark.createDataFrame(pages, "url string, html string")
    assert sorted(map(tuple, url_filters.link_edges(df).collect())) == [
        ("http://a.net/1", "http://a.net/3"), ("http://a.net/1", "http://b.net/2?x=1&y=2"), ("http://c.net/", "http://c.net/d&amp;e")]
    rows = spark.createDataFrame([(1, "http://q.net/a", '<meta http-equiv=refresh content="9"><meta http-equiv=refresh content="0;url=http://q.net/a">'
                                                        '<link rel=canonical href="http://r.net/b"><link rel=canonical href="http://shop.com/de/1?a&amp;b">'),
                                  (2, "http://r.net/b", "")], "page_id long, url string, html string")
    assert {r.verdict for r in url_filters.judge(rows, links=url_filters.link_edges(rows)).collect()} == {"block"}
