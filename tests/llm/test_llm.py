"""The corpus operators against brute force and on awkward tables."""

import collections
import hashlib
import html
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberplane.llm import common, decontaminate, exact_dedup, html_text, idcoder, jaccard, language, packing, repeats, sharding, token_files, tokens, toxicity

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
rng = random.Random(5)


def words(n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(n))


PASSAGE = words(80)
AWKWARD = [
    (0, None), (1, ""), (2, "  \n\t "), (3, "One"), (4, "one two"), (5, PASSAGE), (6, PASSAGE), (7, PASSAGE.replace(" ", "\n")), (8, words(9) + " " + PASSAGE),
    (9, "a" * 3000), (10, words(4000)), (11, "12 345 !!"), (12, "é" * 150 + " naïve <|endoftext|>  x \n\n y "), (13, PASSAGE[:-3]), (None, "lost id"), (6, PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else ("en", "de")[k % 2], "s", 1, 2) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(real, docs, n, num):
    for table in (real, docs.filter("doc_id IS NOT NULL")):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(table, n, num, 100).collect()}
        assert got == brute_components([(r.doc_id, r.text) for r in table.collect()], n, num, 100)
    assert jaccard.ngram_jaccard_join(docs).count() == len(AWKWARD)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def brute_removed(texts, length):
    n = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [100, 200])
def test_removed_bytes(docs, real, length):
    for table in (docs, real):
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed_bytes(table, length, 2).collect())
        assert got == brute_removed([(r.text or "").encode() for r in table.collect()], length)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PASSAGE[:300]), (2, "tiny one"), (3, None), (4, "  ")], "item_id long, text string")
    edited = list(PASSAGE[:300])
    for k in range(20, 300, 25):
        edited[k] = "Q"
    rows = [(0, None), (1, words(50)), (2, words(30) + " " + PASSAGE[:300] + words(30)), (3, words(30) + " " + "".join(edited)), (4, "so TINY\none day"), (5, PASSAGE[:100])]
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontaminate.find_items(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(2, 1), (3, 1), (4, 2)} and got[2, 1] == 0 and got[3, 1] == 12


def test_decontamination_finds_all_within_the_limit():
    own = random.Random(9)
    letters = lambda n: bytes(own.choice(b"abcdefghij klmnop") for _ in range(n))
    items = [(k, letters(own.choice((14, 27, 40, 81, 150, 233)))) for k in range(60)]
    index, lost = decontaminate.Index(items, 0.15), []

    def edited(t, n, regular):
        t, step = list(t), len(t) / max(n, 1)
        for k in [int((j + 0.5) * step) for j in range(n)] if regular else own.sample(range(len(t)), n):
            t[k : k + 1] = own.choice((b"Q" + bytes(t[k : k + 1]), b"", b"X", b"Y"))
        return bytes(t)

    for share in (0.05, 0.10, 0.15):
        for regular in (True, False):
            texts = [letters(own.randint(0, 90)) + edited(t, int(share * len(t)), regular) + letters(own.randint(0, 90)) for _, t in items]
            got = {(k, i): found for k, i, found, _, _ in index.search(texts)}
            for k, text in enumerate(texts):
                for j, t in enumerate(index.texts):
                    limit = int(0.15 * len(t))
                    found = decontaminate.distance(index.mask(j), len(t), text, limit)
                    if found <= limit or (k, index.ids[j]) in got:
                        lost += [(share, regular, k, index.ids[j])] * (got.get((k, index.ids[j])) != found)
            assert len(got) >= len(items)
    assert not lost


def test_sharding(docs, real):
    got = sharding.kd_shards(docs, shards=3).toPandas()
    assert len(got) == len(AWKWARD) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    got = sharding.kd_shards(real, shards=4).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert set(size.index) == {0, 1, 2, 3} and size.max() - size.min() < 2 * got["size"].max()
    sized = sharding.kd_shards(real, target_bytes=100_000).toPandas()
    assert sized.shard.nunique() == -(-int(sized["size"].sum()) // 100_000)


def test_html():
    page = html_text.Page("<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one<br>two <b>three<p>four<script>var a='</p>'</script></article><footer>end</footer>")
    assert [t for _, t, _ in page.blocks] == ["Home", "T & U", "one two three", "four", "end"]


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p"), (-4, "u", "<div class=comments><p>Nice</p></div>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages.unionByName(odd)).collect()}
    assert got[-1] == got[-2] == "" and "Nice" not in got[-4]
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_main_text_decides_by_the_page(spark):
    """Names that only look like those of the list, text in odd elements, pages without a mark, real boilerplate."""
    say = lambda k: " ".join(f"{w}{k}" for w in ("one", "long", "sentence", "that", "is", "about", "something")) + "."
    body = lambda inner: f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{inner}<footer>the end</footer></body></html>"
    cases = [
        (f"<article><div class='book'><p>{say(1)}</p></div><guide>{say(2)}</guide></article>", [say(1), say(2)]),
        (f"<article><p>{say(1)}</p><div class='related-work'><p>{say(2)}</p><p>{say(3)}</p></div><div class='market-share'><p>{say(4)}</p></div></article>", [say(1), say(2), say(3), say(4)]),
        ("<article><p>x <math><mi>E</mi>=mc2</math> y</p><p><noscript>shown</noscript> <object>fallback</object></p></article>", ["x E=mc2 y", "shown fallback"]),
        (f"<div class='story'><h1>Title</h1><p>{say(1)}</p><p>{say(2)}</p></div>", ["Title", say(1), say(2)]),
        (f"<article><p>{say(1)}</p><div class='comments'>{''.join(f'<p>{say(k)}</p>' for k in range(30))}</div><div class='share'><p>{say(2)}</p></div></article>", [say(1)]),
        (f"<article><p>{say(1)}</p><form><p>{say(2)}</p><button>Go</button></form><aside><p>{say(3)}</p></aside></article>", [say(1)]),
    ]
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    odd = spark.createDataFrame([(-k, "u", body(inner), "clash", 1) for k, (inner, _) in enumerate(cases, 1)], pages.schema)
    got = {r.page_id: r.text for r in html_text.main_text(pages.unionByName(odd)).collect()}
    assert [got[-k] for k in range(1, len(cases) + 1)] == ["\n".join(want) for _, want in cases]


def test_exact_dedup_ids(spark):
    rows = [(None, "a b  c"), (1, "a b c"), (2, "abc"), (-(1 << 63), "zz"), (5, "z z "), (6, " z z"), (None, "only"), (None, None), (9, "")]
    got = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    assert got == {
        (None, sha("abc")): (1, False, 3), (1, sha("abc")): (1, True, 3), (2, sha("abc")): (1, False, 3), (-(1 << 63), sha("zz")): (5, False, 3), (5, sha("zz")): (5, True, 3),
        (6, sha("zz")): (5, False, 3), (None, sha("only")): (None, True, 1), (None, sha("")): (9, False, 2), (9, sha("")): (9, True, 2),
    }


def test_exact_dedup(docs, real):
    for table in (docs, real):
        plain = [(r.doc_id, r.text or "") for r in table.collect()]
        key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
        groups = collections.defaultdict(list)
        for i, t in plain:
            groups[key(t)].append((-len(t), i))
        got = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(table).collect() if r.doc_id is not None}
        want = {(i, min(x for x in groups[key(t)] if x[1] is not None)[1], len(groups[key(t)]), hashlib.sha256(key(t).encode()).hexdigest()) for i, t in plain if i is not None}
        assert got == want


@pytest.mark.parametrize("size", [0, 1, 5, 2049, idcoder.BLOCK, idcoder.BLOCK + 1])
def test_coder_round_trip(size):
    ids = np.minimum(np.random.default_rng(size).zipf(1.3, size), 49000).astype("<u4")
    coded = idcoder.encode_segment([7, 8], [ids[: size // 3].tobytes(), ids[size // 3 :].tobytes()])
    docs, lengths, back = idcoder.decode_segment(coded)
    assert docs.tolist() == [7, 8] and lengths.sum() == size and (back == ids).all()
    if size > 5:
        with pytest.raises((ValueError, IndexError)):
            at = 24 + 16 * 2 + 8 * -(-size // idcoder.BLOCK)  # the first coded byte
            idcoder.decode_segment(coded[:at] + bytes([coded[at] ^ 255]) + coded[at + 1 :])


def test_pieces_give_the_library_ids(real):
    texts = [t or "" for _, t in AWKWARD] + [r.text for r in real.collect()] + ["a  b", "a   b ", " \n x", "\n ", "don't  'll", "x 　 y", "a\x1c b \x1c c", " \x85 b", "a \u2003 b", "x ", "  ", " \t b", "a \u00a0b", "see <|endoftext|> here", "<|startoftext|>x <|ENDOFTEXT|>"]
    for path, kind in ((BYTE, "spaced"), (WORD, "words")):
        plain = Tokenizer.from_file(path)
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tokens.encoder(path, kind).encode(texts) == want


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(docs, path, WORD, "words", 2)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_ids(spark.read.parquet(path)).collect())
    at, plain = 0, Tokenizer.from_file(WORD)
    for (i, t), (start, n, crc) in zip(sorted(AWKWARD, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)


def test_packing(docs, real):
    """Every id of every document in exactly one piece, pieces side by side in their sequences, CRCs of the library's ids."""
    plain = Tokenizer.from_file(BYTE)
    for table in (docs.filter("doc_id <> 6"), real):
        got = packing.pack(table, BYTE, "spaced", 0, 64).toPandas()
        ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in table.collect()}
        assert set(got.doc_id) == set(ids)
        for doc, g in got.groupby("doc_id"):
            g = g.sort_values("start")
            assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[doc]) == g.doc_tokens.iloc[0]
            assert g.ids_crc32.tolist() == [zlib.crc32(ids[doc][a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)]
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
        size = got.groupby("sequence_id").length.sum()
        assert all(n == 64 or n & (n - 1) == 0 for n in size)


def test_sharding_cuts(spark, real):
    """Sizes, CRCs and slots of every row; equal texts together; shards near equal."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in real.collect()] + [(10_000, None, None, None), (10_001, "", "en", "s"), (None, "lost", None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit(-1)).withColumn("part", F.lit(1))
    got = sharding.kd_shards(table, shards=8).toPandas()
    text = {i: (t or "").encode() for i, t, _, _ in rows}
    seen = {}
    assert len(got) == len(rows)
    for r in got.itertuples():
        t = text[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        if len(t) < got["size"].sum() / 8 / 32 / 4:
            assert seen.setdefault(t, r.shard) == r.shard
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.shard) == set(range(8))
    for _, g in got.groupby("shard"):
        assert g.sort_values("slot").doc_id.dropna().is_monotonic_increasing
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() < 2 * got["size"].max()


def test_clashing_columns_and_nulls(spark):
    """keep_identified keeps clashing columns as they are; held_out is never null."""
    rows = [(k, words(30), ("en", "de")[k % 2], "x") for k in range(40)] + [(None, words(30), None, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, letter_ string")
    kept = language.keep_identified(table, F.lit(True))
    assert kept.columns == table.columns and {r.letter_ for r in kept.collect()} <= {"x", "y"}
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    clash = table.select("doc_id", "text", F.lit(1).alias("toxic"), F.lit(0.5).alias("score"), F.lit(2).alias("fold"))
    assert toxicity.score_toxicity(clash, labels.withColumn("text", F.lit("clash")), F.col("doc_id") < 30).count() == len(rows)
    items = spark.createDataFrame([(1, PASSAGE, "clash")], "item_id long, text string, doc_id string")
    assert decontaminate.find_items(table.withColumn("item_id", F.lit(0)), items).count() == 0


def test_language(docs, real, spark):
    got = {r.doc_id: r for r in language.identify_language(docs, F.lit(True)).collect()}
    assert got[0].lang_pred == got[2].lang_pred == got[11].lang_pred == "und" and got[0].score == 0
    held = F.col("doc_id") % 4 == 2
    found = language.identify_language(real, ~held).join(real.select("doc_id", "lang"), "doc_id").filter(held)
    assert found.filter("lang = lang_pred").count() > 0.9 * found.count()


def test_toxicity(spark):
    rows = [(k, words(60) + (" vile scum idiot" if k % 4 == 0 else "")) for k in range(400)]
    table = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, labels, F.col("doc_id") < 300).collect()}
    held = [(got[k], k % 4 == 0) for k in range(300, 400)]
    assert min(s for s, toxic in held if toxic) > max(s for s, toxic in held if not toxic)
    assert got[1000] == got[1001]


def test_toxicity_keeps_rare_runs(spark):
    """Expressions of one or two training rows each, among more repeated runs than 2^18."""
    own = random.Random(3)
    text = lambda n: "".join(own.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    plain, rare = [text(1000) for _ in range(330)], ["".join(own.choice("bcdfgklmprtvxz") for _ in range(14)) for _ in range(100)]
    rows = [(k, t, 0) for k, t in enumerate(plain * 3)]
    rows += [(2000 + k, text(150) + " " + rare[k % 100] + " " + text(150), 1) for k in range(200)]
    rows += [(5000 + k, text(150) + " " + (rare[k] if k < 100 else text(14)) + " " + text(150), int(k < 100)) for k in range(200)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, labels, F.col("doc_id") < 5000).collect()}
    pairs = [got[5000 + a] > got[5100 + b] for a in range(100) for b in range(100)]
    assert sum(pairs) / len(pairs) > 0.9


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.ngram_jaccard_join(none).count() == repeats.removed_bytes(none).count() == exact_dedup.exact_dedup(none).count() == 0
    assert sharding.kd_shards(none, shards=8).count() == packing.pack(none, BYTE, "spaced", 0).count() == 0
    assert language.identify_language(none, F.lit(True)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs, items).count() == decontaminate.find_items(none, items).count() == 0
    assert toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    made = token_files.encoded(none, WORD, "words", 2)
    assert token_files.read_ids(made).count() == 0


def test_pipeline(spark, real):
    got = corpus_pipeline.run(spark, SF).toPandas()
    rows = {r.doc_id: r.text for r in real.collect()}
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = collections.defaultdict(list)
    for i, t in rows.items():
        groups[key(t)].append((-len(t), i))
    left = [(i, rows[i]) for i in sorted(min(g)[1] for g in groups.values())]
    near = brute_components(left, 5, 80, 100)
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, t in left if near[i][1] == i and not any(x in decontaminate.plain(t) for x in items)}
    assert set(got.doc_id) == want


def test_jaccard_word_structure(spark):
    """Texts of Thue-Morse words, which polynomial hashes confuse, share no shingle and must not link."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, "x " + a), (4, a[:300] + " " + a[300:] + " y")]
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_jaccard_large_group(spark):
    """Variants of one document in two families that do not link, chains, and copies in upper case."""
    own = random.Random(2)
    base = words(120).split()
    rows = []
    for k in range(150):
        t = list(base)
        for j in own.sample(range(120), own.choice((0, 1, 1, 2, 3, 6))):
            t[j] = "".join(own.choice("stuvwxyz") for _ in range(9))
        rows.append((1000 - k, " ".join(t)))
    rows += [(2000 + k, t.upper() if k % 2 else t + "  ") for k, (_, t) in enumerate(rows[:30])] + [(5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(table, 3, 90, 100).collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_pipeline_rows_of_one_id(spark, real, tmp_path):
    """Copies and unlike texts that share an id, rows without one, clashing columns, and an empty table."""
    real.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(1, words(60))], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    some = [r.text for r in real.filter("lang = 'en' AND n_chars > 800").orderBy("doc_id").limit(3).collect()]
    rows = [(1, some[0]), (1, some[0] + " "), (1, some[1]), (None, some[0]), (None, some[2]), (7, some[2].replace(" ", "  ")), (8, some[2] + " one more"), (9, None), (9, " 12 ")]
    table = spark.createDataFrame([(i, t, "en", "s", 1, "k", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row string, component_id int")
    kept = corpus_pipeline.dedup(spark, table, f"{tmp_path}/sf")
    assert kept.columns == table.columns
    # Of some[0] the longest stays, of some[2] the one with wider gaps, both as rows of their own.
    assert sorted(r.component_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8]
    near = corpus_pipeline.near_dedup(spark, kept, f"{tmp_path}/sf")
    assert sorted(r.component_id for r in near.collect()) == [1, 2, 5, 7, 8]
    assert sorted(r.component_id for r in corpus_pipeline.clean(spark, near, f"{tmp_path}/sf").collect()) == [1, 2, 5, 7, 8]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), f"{tmp_path}/sf").count() == 0


def apart(pattern, text):
    """Least edits between a pattern and any part of a text, by the plain recurrence."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k - 1] + (p != c), row[k] + 1, new[k - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_against_plain_distances(spark):
    """Items of all lengths, also of few bytes, in three blocks, with random edits, against the recurrence."""
    own = random.Random(21)
    letters = lambda n: "".join(own.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip() or "x"
    items = {k: letters(n) for k, n in enumerate([*range(1, 40), 50, 60, 70, 80])}
    items[100] = "quick brownfx"

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            at, how = own.randrange(len(t) + 1), own.randrange(3)
            t[at : at + (how > 0)] = own.choice("qxz") if how < 2 else ""
        return "".join(t)

    rows = [(0, "the quick brownfox jumps"), (1, None), (2, "")]
    rows += [(10 + j, f"{letters(own.randint(0, 60))} {edited(t, own.randint(0, int(0.2 * len(t)) + 1))} {letters(own.randint(0, 60))}") for j, t in enumerate(list(items.values()) * 3)]
    size = sum(len(t.encode()) for t in items.values())
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_items(table, spark.createDataFrame(list(items.items()), "item_id long, text string"), block_bytes=-(-size // 3))
    got = {(r.doc_id, r.item_id): r.edit_distance for r in found.collect()}
    want = {}
    for i, t in rows:
        for k, item in items.items():
            a, b = decontaminate.plain(item), decontaminate.plain(t)
            d = apart(a, b)
            if d <= int(0.15 * len(a)) and b:
                want[i, k] = d
    assert got == want and got[0, 100] == 1 and sum(d > 0 for d in want.values()) > 40


def test_unclosed_elements_end_at_the_next_block():
    for source, blocks in (
        ("<article><p>a</p><button>x<p>b</p></article>", ["a", "b"]), ("<p>a</p><select><option>1<p>b</p>", ["a", "b"]), ("<p>a<svg><g>t</g></svg>b</p>", ["ab"]), ("<p>a</p><svg><g>t<p>b</p>", ["a", "b"]),
        ("<p>a</p><textarea>t<p>b</p>", ["a", "b"]), ("<p>q <button>u<button>x</button>z</p><p>w</p>", ["q z", "w"]), ("<div><button><div>x</div></button>y</div>", ["y"]), ("<p>x <button>y", ["x"]), ("<form><button>s<script>'</button>'</script>t</button>u</form>", ["u"]),
    ):
        assert [b.replace("a b", "ab") for _, b, _ in html_text.Page(source).blocks] == blocks


def brute_leaves(rows, leaves, upto):
    """rows(weight, dims, tie): widest dimension, keys in order, the cut nearest to the share, side by side."""
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update({k: first for k in own})
            return
        spans = [max(rows[k][1][d] for k in own) - min(rows[k][1][d] for k in own) for d in range(4)]
        dim = spans.index(max(spans))
        key = lambda k: (rows[k][1][dim], rows[k][2] & 0xFFFFFFFF)
        left = n // 2
        width = upto[first + n] - upto[first]
        aim = sum(rows[k][0] for k in own) * ((upto[first + left] - upto[first]) / width if width else left / n)
        low, at, done = [], 0, 0
        for k in sorted(own, key=key):
            if at >= aim:
                break
            done, at = at, at + rows[k][0]
            low.append(k)
        if low and aim - done < at - aim:
            low.pop()
        split(low, first, left)
        split([k for k in own if k not in low], first + left, n - left)

    split(list(rows), 0, leaves)
    return out


def test_kd_cuts_against_sorting(spark):
    own = random.Random(17)
    rows = {k: (own.choice((1, 1, 2, 50, 900)), (own.randrange(1 << 31), own.choice((0, 5, 9)), own.randrange(100), 0), own.getrandbits(63)) for k in range(400)}
    table = spark.createDataFrame([(k, w, *d, t) for k, (w, d, t) in rows.items()], "k int, weight long, d0 long, d1 long, d2 long, d3 long, tie long")
    total = sum(w for w, _, _ in rows.values())
    even = [total * k / 7 for k in range(8)]
    uneven = [0.0, 0.0, total * 0.5, total * 0.5, total * 0.7, total * 0.8, total * 0.9, float(total)]
    assert {r.k: r.leaf for r in sharding.kd_leaves(table, 7).collect()} == brute_leaves(rows, 7, even)
    aims = spark.createDataFrame(list(enumerate(uneven)), "leaf int, upto double")
    assert {r.k: r.leaf for r in sharding.kd_leaves(table, 7, aims).collect()} == brute_leaves(rows, 7, uneven)


def test_equal_texts_share_a_shard(spark):
    """Groups of copies up to a whole shard stay together and shards are even; only larger ones are dealt."""
    own = random.Random(4)
    text = lambda n: "".join(own.choice("abcdefgh ") for _ in range(n))
    texts = [text(300) for _ in range(900)] + [t for t, n in ((text(300), 150), (text(200), 120), (text(400), 60), (text(150), 300)) for _ in range(n)]
    table = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = sharding.kd_shards(table, shards=8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.05
    by = collections.defaultdict(set)
    for r in got.itertuples():
        by[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    one = sharding.kd_shards(spark.createDataFrame([(k, "same text " * 9, "s") for k in range(800)], "doc_id long, text string, source string"), shards=4).toPandas()
    sizes = one.groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() / sizes.min() < 1.5 and one.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_coder_takes_all_ids_and_less_room_than_zlib(real):
    ids = np.array([0, 65_534, 65_535, 65_536, (1 << 32) - 1, 5, 65_535, 7] * 50, "<u4")
    assert (idcoder.decode_segment(idcoder.encode_segment([1], [ids.tobytes()]))[2] == ids).all()
    plain = Tokenizer.from_file(WORD)
    text = np.array([i for r in real.collect() for i in plain.encode(r.text or "", add_special_tokens=False).ids], "<u4")[: 2 * idcoder.BLOCK]
    coded = len(idcoder.encode_segment([1], [text.tobytes()]))
    assert coded < sum(len(zlib.compress(text[k : k + idcoder.BLOCK].tobytes(), 9)) for k in range(0, len(text), idcoder.BLOCK))


def test_blocks_of_a_segment_learn_from_each_other():
    rng = np.random.default_rng(11)
    phrases = rng.integers(0, 3000, (400, 40))
    ids = phrases[rng.integers(0, 400, 16 * idcoder.BLOCK // 40 + 1)].ravel()[: 16 * idcoder.BLOCK].astype("<u4")
    coded = idcoder.encode_segment([1], [ids.tobytes()])
    assert (idcoder.decode_segment(coded)[2] == ids).all()
    assert len(coded) < 8 * len(idcoder.encode_segment([1], [ids[: idcoder.BLOCK].tobytes()]))


@pytest.mark.parametrize("lanes", [1, 3, 50])
def test_coder_round_trip_of_many_lanes_and_new_ids(monkeypatch, lanes):
    monkeypatch.setattr(idcoder, "LANES", lanes)
    monkeypatch.setattr(idcoder, "STEPS", 100)
    rng = np.random.default_rng(lanes)
    ids = np.concatenate([rng.integers(0, 1 << 16, 4001), np.repeat(rng.integers(0, 1 << 32, 40), 50), np.minimum(rng.zipf(1.2, 5000), 70_000)]).astype("<u4")
    coded = idcoder.encode_segment([3], [ids.tobytes()])
    assert (idcoder.decode_segment(coded)[2] == ids).all()
    for at in (24 + 16, len(coded) // 2, len(coded) - 1):
        with pytest.raises((ValueError, IndexError)):
            idcoder.decode_segment(coded[:at] + bytes([coded[at] ^ 64]) + coded[at + 1 :])
    with pytest.raises((ValueError, IndexError)):
        idcoder.decode_segment(coded[:-4])


@pytest.mark.parametrize("meet", [3, 1024])
def test_jaccard_pairs_and_links(spark, real, monkeypatch, meet):
    """All links between different sets, also within a component and in blocks of a frequent shingle, against brute force."""
    monkeypatch.setattr(jaccard, "MEET", meet)
    own = random.Random(8)
    base = words(300).split()
    rows = [(r.doc_id, r.text) for r in real.limit(60).collect()] + [(5000, None), (5001, "")]
    for k in range(70):
        t = list(base)
        for j in own.sample(range(300), own.choice((0, 0, 1, 2, 4, 9))):
            t[j] = "x" * own.randint(2, 9)
        rows.append((6000 - k, " ".join(t)))
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    reps = {s: min(i for i in sets if sets[i] == s) for s in sets.values() if s}
    want = {}
    for a, x in sorted((i, s) for s, i in reps.items()):
        for b, y in ((i, s) for s, i in reps.items()):
            if a < b and 100 * len(x & y) >= 90 * len(x | y):
                want[a, b] = (len(x & y), len(x), len(y))
    members, pairs = jaccard.ngram_jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert {(r.a, r.b): (r.shared, r.n_a, r.n_b) for r in pairs.collect()} == want and len(want) > 100
    assert {r.doc_id: (r.n_shingles, r.class_id) for r in members.collect()} == {i: (len(s), reps.get(s, i)) for i, s in sets.items()}
    counts = {r.doc_id: r.n_links for r in jaccard.link_counts(members, pairs).collect()}
    assert counts == {i: sum(j != i and bool(s) and 100 * len(s & t) >= 90 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}


def test_toxicity_bounds_the_text_that_it_learns_from(spark):
    """A few rows of much text: fewer rows are counted, and the others are scored as before."""
    own = random.Random(5)
    text = lambda n: "".join(own.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(k, text(400) + (" qzxvq wjzkq" if k % 2 else ""), k % 2) for k in range(400)] + [(900, text(60_000), 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, table.select("doc_id", "toxic"), F.col("doc_id") % 5 != 0, class_bytes=40_000).collect()}
    held = [k for k in range(400) if k % 5 == 0]
    assert len(got) == len(rows) and min(got[k] for k in held if k % 2) > max(got[k] for k in held if k % 2 == 0)


def test_language_decoding_by_hand(spark):
    """Counts, log odds, trusts of the bits and loss-weighted decoding, worked out n-gram by n-gram."""
    own = random.Random(31)
    letters = {"aa": "abcdeé ", "bb": "abcdxyz ", "cc": "aexyzüß "}
    rows = [(k, "".join(own.choice(letters[x]) for _ in range(own.randint(1, 60))), x) for k, x in enumerate(sorted(letters) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_language(table, F.lit(True), weight_rows=10**6).collect()}

    def grams(text):
        raw = text.encode().lower()
        for n in (1, 2, 3):
            for k in range(len(raw) - n + 1):
                yield ((int.from_bytes(raw[k : k + n], "big") * 2654435761 + n * 40503) % 2**32 * 2246822519) % 2**32 >> 17

    langs, cells = sorted(letters), 1 << 15
    counts = {x: collections.Counter(g for _, t, y in rows if y == x for g in grams(t)) for x in langs}
    share = {x: {g: (counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * cells) for g in set().union(*counts.values())} for x in langs}
    words = list(zip(*[(1, *c) for c in ((1, -1), (-1, 1), (-1, -1))], strict=True))  # all splits of three languages

    def odds(text, bit):
        mean = lambda sign, g: np.mean([share[x][g] for x, w in zip(langs, words, strict=True) if w[bit] == sign])
        return np.mean([np.log(mean(1, g)) - np.log(mean(-1, g)) for g in grams(text)])

    margin = {i: [odds(t, b) for b in range(3)] for i, t, _ in rows}
    trust = []
    for b in range(3):
        wrong = sum(margin[i][b] * words[langs.index(x)][b] <= 0 for i, _, x in rows)
        error = (wrong + 0.5) / (len(rows) + 1)
        trust.append(max(0.05, 0.5 * np.log((1 - error) / error)))
    for i, t, _ in rows:
        loss = [sum(w / sum(trust) * np.log1p(np.exp(-12 * m * s)) for w, m, s in zip(trust, margin[i], word, strict=True)) for word in words]
        p = np.exp(-3 * (np.array(loss) - min(loss)))
        p /= p.sum()
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].score == pytest.approx(p.max(), abs=1e-4)
            assert got[i].lang_pred == langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4


def test_margins_take_little_memory():
    """A slice of 2 MB took 140 MB in each Python worker."""
    texts = pa.array([f"some words of text {k} " * 40 for k in range(2200)])
    weights = np.random.default_rng(1).normal(size=(1 << language.BITS, 7)).astype(np.float32)
    tracemalloc.start()
    got = language.margins(texts, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and peak < 40e6
    assert (got[1000:1003] == language.margins(texts.slice(1000, 3), weights)).all()


def test_different_pieces_are_encoded_once(monkeypatch):
    coder, plain, given = tokens.Encoder(BYTE, "spaced"), Tokenizer.from_file(BYTE), []
    monkeypatch.setattr(coder, "_ids", lambda texts, f=coder._ids: given.extend(texts) or f(texts))
    texts = ["une forêt", "One word, one word.\nOne word!! été. One\n\nword  (one) don't.", None, " ", "", "a ", "\nword\n", "word\u00a0.\n x", "×, ÷."] * 2
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.encode(texts) == want and coder.encode(texts) == want
    assert len(given) == len(set(given)) and not {" word,", " word."} & set(given)
    given.clear()
    assert coder.encode(["One word; one word,"]) == [np.array(plain.encode("One word; one word,", add_special_tokens=False).ids, "<u4").tobytes()]
    assert given == [";"]


def test_words_are_encoded_by_lines(real, monkeypatch):
    monkeypatch.setattr(tokens, "LINE", 7)
    coder, plain = tokens.Encoder(WORD, "words"), Tokenizer.from_file(WORD)
    texts = [r.text for r in real.limit(40).collect()] + ["It's one word's, ÀÉ Straße ßÿ ı İx ſ K\u0331 e\u0301t\u00e9 a</w> </w> 3rd x\u00b5 \u4e2d\u6587 word", "Bonjour", " z\u0300 y"]
    given = []
    monkeypatch.setattr(coder, "_ids", lambda texts, f=coder._ids: given.extend(texts) or f(texts))
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.encode(texts) == want
    assert given and not {" word", " one", "Bonjour"} & set(given)
    monkeypatch.setattr(tokens, "CACHE", 0)
    assert tokens.Encoder(WORD, "words").encode(texts) == want
    other = tokens.Encoder(WORD, "words")
    other.ends[:] = False  # lines that can't be told apart go word by word
    assert other.encode(texts) == want


def test_an_added_token_across_two_texts():
    for path, kind in ((BYTE, "spaced"), (WORD, "words"), (BYTE, "whole")):
        plain = Tokenizer.from_file(path)
        texts = ["a <|endof", "text|> b", "c <|endoftext|> d", "", "e"]
        assert tokens.Encoder(path, kind).encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("room", [1 << 14, 16 << 20])
def test_distances_side_by_side(monkeypatch, room):
    monkeypatch.setattr(decontaminate, "MASKS", room)
    rng = random.Random(5)
    draw = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    index = decontaminate.Index([(i, draw(b"abcde ", m)) for i, m in enumerate((8, 20, 63, 64, 65, 127, 128, 129, 300, 700))], 0.15)
    items, texts = [], []
    for i in sorted(rng.randrange(10) for _ in range(300)):
        text = bytearray(index.texts[i])
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = draw(b"abq", rng.randrange(2))
        items.append(i)
        texts.append((draw(b"abcde", rng.randrange(20)) + bytes(text) + draw(b"abcde", rng.randrange(20)))[: rng.choice((2000, 2000, 30, 0))])
    assert index.distances(np.array(items), texts) == [decontaminate.distance(index.mask(i), len(index.texts[i]), t, 0) for i, t in zip(items, texts, strict=True)]


def test_shares_of_frequencies_are_whole_number_arithmetic():
    model, rng = idcoder.Bytes(3, 2), np.random.default_rng(4)
    for _ in range(400):
        tables = np.unique(rng.integers(0, 6, 4))
        model.seen(tables, rng.zipf(1.5, len(tables)) % 256)
    model.counts[5] = rng.integers(1, 3000, 256)
    model.counts[5, 7] = 48 * idcoder.BLOCK
    model.total[:] = model.counts.sum(1)
    model.rebuild()
    for own, total, cum in zip(model.counts.tolist(), model.total.tolist(), model.cum.tolist(), strict=True):
        want = np.cumsum([0] + [x * (idcoder.TOTAL - 256) // total + 1 for x in own]).tolist()
        assert cum == [*want[:256], idcoder.TOTAL]
