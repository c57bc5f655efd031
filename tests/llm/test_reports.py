"""Divergence of sources, archives with their history, and repair of conversations: against SQL, brute force and broken input."""

import base64
import gzip
import hashlib
import heapq
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberplane.llm import conversations, divergence, queries, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n long, term string"
own = random.Random(11)


def same(got, table, name, sql):
    con = duckdb.connect()
    con.register("frame", table.toPandas().astype(object).where(lambda x: x.notna(), None))
    casts = ", ".join(f"CAST({f.name} AS {'BIGINT' if f.dataType.simpleString() == 'bigint' else 'VARCHAR'}) AS {f.name}" for f in table.schema)
    con.execute(f"CREATE TABLE {name} AS SELECT {casts} FROM frame")
    want = con.execute(sql).df()
    rows = lambda df: sorted(map(repr, (tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_warc", "op13_conversation_repair"])
def test_equals_sql(spark, name):
    table = {"op11": "documents", "op12": "pages", "op13": "conversations"}[name[:4]]
    same(queries.queries()[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet"), table, queries.oracle_sql()[name])


# Divergence


def test_divergence_awkward(spark):
    """Nulls, no terms, NUL and other scripts, ties, one hot source, several blocks, clashing names."""
    rows = [(k, f"Alpha beta {'gamma ' * (k % 3)} ÉTÉ\0delta_{own.choice('xyz')} 12 w{own.choice('abcdefgh')}ord", own.choice(["en", "de", None]), own.choice(["s", "s", "s", "t", None, "ü"]), 1, "x") for k in range(180)]
    rows += [(None, None, "en", "empty", 0, ""), (7, "", "fr", "only", 0, ""), (7, "once upon", "it", "a", 0, ""), (7, None, "it", "b", 0, ""), (1, "word " * 5000, "en", "t", 0, "")]
    table = spark.createDataFrame(rows, DOC)
    for block in (divergence.BLOCK, 3):
        same(divergence.divergence(table, block=block), table.select("doc_id", "text", "lang", "source"), "documents", queries.DIVERGENCE)
    assert divergence.divergence(table.limit(0)).count() == 0


def test_divergence_of_large_counts():
    """Counts beyond what 64 bits bear when scaled stay exact."""
    counts = np.array([0, 0, 5, 5, 5, 10**13, 0])
    starts, p = divergence.encoded(counts, 10**13 + 15, 7)
    assert starts.tolist() == [0, 2, 5, 6] and p.tolist() == [1 + 10**9 * (c + 2) // (10**13 + 15 + 14) for c in (0, 5, 10**13, 0)]
    other = divergence.encoded(np.array([1, 0, 0, 5, 5, 5, 9]), 25, 7)
    dense = [[1 + 10**9 * (c + 2) // (t + 14) for c in col] for col, t in ((counts.tolist(), 10**13 + 15), ([1, 0, 0, 5, 5, 5, 9], 25))]
    assert divergence.apart((starts, p), other, 7) == sum((x - y) ** 2 // (x + y) for x, y in zip(*dense, strict=True))


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    raw = b"abcdefghijk lm  n opqrstuvwxyz "
    assert list(itertools.chain(*divergence.pieces(raw))) == raw.split()


# Archives


PAGES = [
    (1, "http://www.A.example.com:80/x?b=2&a=1#top", "<p>one</p>"), (2, "https://a.example.com/x?a=1&b=2", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://b.example.com", "line\r\n\r\nWARC/1.1\r\nend\r\n\r\n"),
    (6, "http://user@b.example.com/a b\n", "ü\0" * 3000), (7, "ftp://c.example.org/", "<p>one</p>"), (None, "http://d.example/", "<p>one</p>"), (7, "ftp://c.example.org/", "<p>one</p>"), (8, "no scheme", "x" * 400_000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in PAGES], "page_id long, url string, html string, sha string, offset long")


def archived(spark, pages, path, **kw):
    path = f"file://{path}/archives"
    warc.write_archives(pages, path, **kw)
    return path, warc.capture_history(warc.read_archives(spark, path), most=3)


def test_archives(spark, pages, tmp_path):
    _, history = archived(spark, pages, tmp_path)
    rows = sorted(history.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(PAGES)))
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in PAGES:
        latest = max(j for j, _, u in PAGES if j is not None and (u or "") == (t or ""))
        again = i is not None and i < latest
        want.append((i, len((t or "").encode()), sha(t), "revisit" if again else "response", latest if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    found = {r.page_id: r for r in rows}
    assert found[1].url_key == found[2].url_key == "com,example,a)/x?a=1&b=2" and found[3].url == "urn:page:3" and found[6].url_key == "com,example,b)/a%20b%0A"


def test_archives_hold_the_payloads(spark, pages, tmp_path):
    """Offsets and lengths of the history cut whole records out of the archives."""
    texts = {i: (t or "").encode() for i, _, t in PAGES}
    for how, opened in (("none", lambda raw: raw), ("gzip", gzip.decompress)):
        _, history = archived(spark, pages, tmp_path / how, compression=how)
        for r in history.collect():
            raw = opened((tmp_path / how / "archives" / r.archive).read_bytes())[r.offset : r.offset + r.length]
            holds(raw, r, texts)


def holds(raw, r, texts):
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert raw[:-4].split(b"\r\n\r\n", 2)[2] == (texts[r.page_id] if r.record_type == "response" and r.page_id else texts[7] if r.page_id is None else b"")


def test_small_payloads_are_never_revisits(spark, pages, tmp_path):
    _, history = archived(spark, pages, tmp_path, least_bytes=5)
    assert {r.page_id for r in history.filter("record_type = 'revisit'").collect()} == {1, 2}


def test_given_times_order_the_history(spark, tmp_path):
    table = spark.createDataFrame([(k, "http://h.example/", f"v{k}", 100 - k) for k in range(50)], "page_id long, url string, html string, at int")
    _, history = archived(spark, table, tmp_path, captured=F.expr("timestampadd(DAY, at, TIMESTAMP_NTZ'2020-03-28 02:30:00')"))
    rows = sorted(history.collect(), key=lambda r: r.place)
    assert [r.page_id for r in rows] == list(range(49, -1, -1)) and rows[0].captured == "2020-05-18T02:30:00Z"


def test_broken_archives_are_errors(spark, pages, tmp_path):
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/archives", compression="none")
    file = max((tmp_path / "archives").glob("part-*"), key=lambda f: f.stat().st_size)
    good = file.read_bytes()
    list(warc.captures(good, "a"))
    for bad in (good.replace(b"xxxx", b"xxyx", 1), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.1", 1)):
        with pytest.raises(ValueError, match="a: "):
            list(warc.captures(bad, "a"))


def test_empty_table(spark, pages, tmp_path):
    assert archived(spark, pages.limit(0), tmp_path)[1].count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    runs = [sorted((own.randint(0, 9), r, i) for i in range(own.randint(0, 12))) for r in range(k)]
    assert [runs[r][i] for r, i in warc.merge(runs)] == list(heapq.merge(*runs))


# Conversations


def brute(rows):
    """Cheapest edits by trying them in the order of cost and audit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, facts, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last[1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        facts.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        ways = []
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((3, "D", i + 1, "", None))
            if facts[i] not in (0, 1):
                more = int(facts[i] == 2)
                ways += [(more, "K", i + 1, role[:1], f"{role}:{text}")] if role else []
                ways += [(2 + more, "R", i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        ways += [(2, "I", i, r[0], f"{r}:") for r in ("user", "assistant")]
        for c, letter, j, initial, line in ways:
            if re.fullmatch("s?(ua)*u?", roles + initial):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + initial, lines + ((line,) if line is not None else ())))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk(n):
    role = lambda: own.choice(["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "User"])
    return [(own.choice([None, *range(n)]) if own.random() < 0.2 else k, role(), own.choice(["Yes.", "No!", "so", "", " \n", "why? \t", f"{k} ok."])) for k in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_repair(spark, monkeypatch, block):
    """Against brute force; with blocks of three rows every conversation is folded from several."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    convs = {k: talk(own.randint(0, 9)) for k in range(60)} | {100: talk(40), 101: [(0, "user", "a.")] * 30, None: talk(5), 102: [(None, "system", "x.")] * 2}
    rows = [(c, *r, 1, "clash") for c, turns in convs.items() for r in turns]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos long, code string")
    everyone = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(table, everyone).collect()}
    assert got == {c: brute(turns) for c, turns in convs.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (1, 3, "assistant", ""), (2, None, None, None), (3, 5, "assistant", "C.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversations.repaired(table, conversations.audits(table))
    assert [tuple(r) for r in out.orderBy("conv_id", "place").collect()] == [(1, 0, 0, "system", "S.", "K"), (1, 1, 1, "user", "A.", "R"), (1, 2, 2, "assistant", "B.", "K"), (3, 0, None, "user", "", "I"), (3, 1, 5, "assistant", "C.", "K")]


def test_text_ids_and_no_rows(spark):
    table = spark.createDataFrame([("a", 0, "user", "x.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in conversations.audits(table).collect()] == [("a", 0, 0, 0, 0, 0, 2, "KI")]
    empty = table.limit(0)
    assert conversations.repair_report(empty, table).first().audit == "" and conversations.repair_report(empty, empty).count() == 0
