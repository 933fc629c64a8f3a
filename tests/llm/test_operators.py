"""Each operator against a plain definition, on rows with nulls, repeats, long texts and odd columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import (
    batches,
    byte_pairs,
    components,
    decontaminate,
    html_text,
    quality,
    simhash,
    substring,
    token_files,
    topk,
    url_filter,
    word_pieces,
)

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = " \t\n\r  'slabcdeABC19٣é漢🙂!?.,\x85\xa0İſ"


def some_texts(seed, count=200, length=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(LETTERS, k=rnd.randrange(length))) for _ in range(count)]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return byte_pairs.Encoder(byte_pairs.read_ranks(file.read()), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (4, " \n "), (5, "ab é " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_words", "ids", "hits", "key", "doc", "row", "f", "kept", "a.b"):
        df = df.withColumn(name, F.lit("old"))
    return df


def test_encoding_is_that_of_the_library(encoder, tiktoken_ids):
    for text in some_texts(1, 2000) + ["ab" * 5000, "  \n\n  x", "don't DON'T", "<|endoftext|>"]:
        assert encoder.ids(text) == tiktoken_ids(text)


def test_prefix_table_appends_and_edits(encoder):
    rnd = random.Random(2)
    table = byte_pairs.PrefixTable(encoder.ranks, b"the")
    for _ in range(200):
        start = rnd.randrange(len(table.content) + 1)
        stop = min(len(table.content), start + rnd.randrange(4))
        table.edit(start, stop, bytes(rnd.choices(b"thaeinrs", k=rnd.randrange(5))))
        table.append(b"e" * rnd.randrange(2))
        fresh = byte_pairs.PrefixTable(encoder.ranks, table.content)
        assert table.last == fresh.last and table.ids() == fresh.ids()
    long = byte_pairs.PrefixTable(encoder.ranks, b"tha" * 5000)
    assert long.edit(6000, 6002, b"xyz") < 500


def test_encoded_text_keeps_up_with_edits(encoder, tiktoken_ids):
    rnd, text = random.Random(3), byte_pairs.EncodedText(encoder)
    for new in some_texts(4, 400, 8):
        start = rnd.randrange(len(text.text) + 1)
        text.edit(start, min(len(text.text), start + rnd.randrange(5)), new)
        assert text.ids() == tiktoken_ids(text.text)


def test_encode_and_decode_columns(spark, odd_docs, tiktoken_ids):
    encoded = byte_pairs.encode(odd_docs, "text", RANKS, P.PATTERN)
    assert set(encoded.columns) == set(odd_docs.columns)
    rows = byte_pairs.decode(encoded, "ids", RANKS).collect()
    assert len(rows) == 7
    for row in rows:
        assert row.ids == tiktoken_ids(row.text or "")
        assert bytes(row.content).decode() == (row.text or "")
    empty = spark.createDataFrame([], "text string")
    assert byte_pairs.encode(empty, "text", RANKS, P.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body>
<header>Site</header><div class="menu"><a href="x">One</a></div><script>var t="</p>";</script>
<div class=content><h1>Title &lt;x&gt;</h1><p><b>First  {}<br><p>Second&nbsp;&amp more<ul><li>a<li>b</ul></div>
<div id="side-bar sidebar">side</div><section class="comments"><p>nice</p></section><footer>end</footer></body>"""


def test_main_text():
    words = "word " * 80
    expected = "\n".join(["Title <x>", f"First {words.strip()}", "Second & more", "a", "b"])
    assert html_text.main_text(PAGE.format(words)) == expected
    assert html_text.main_text("") == ""
    assert html_text.main_text("plain & simple") == "plain & simple"
    assert html_text.main_text('<p>cut <a href="') == "cut"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<article><p>text</p><nav>x</nav></article><!-- open") == "text"


def test_main_text_of_tags_with_quotes():
    for tag in ("<p title=l'eau>", "<p alt=it's x=1>", '<p size=5">', "<p 'x>", "<p a = l'eau/b' c='>'>", "<p a=\"'>\" b='\">'>"):
        assert html_text.main_text(f"<div>{tag}it's \"one\"</p><p>don't two</p></div>") == "it's \"one\"\ndon't two"
    assert html_text.main_text("<p>one</p><p title='open>two</p><p>three</p>") == "one\ntwo\nthree"
    assert html_text.main_text('<p>one</p><p title="open>two</p><p class="x">three</p>') == "one\nthree"
    assert html_text.main_text("<p>one <a title='open>two, 'three") == "one two, 'three"
    assert html_text.main_text("<p>one</p><p class=l'ad>two</p><p title=l'id=menu>three</p><p title=\"a hidden ad\">four</p>") == "one\nthree\nfour"


def test_wrappers_keep_their_text_whatever_their_names():
    said = [f"Paragraph {i} " + "tells of many things, one after the other, " * 6 + "and ends." for i in range(3)]
    paragraphs = "".join(f"<p>{s}</p>" for s in said)
    around = '<div class="menu"><a href=x>home</a></div>{}<div class="sidebar">short words here</div>'
    for names in (
        "content with-sidebar", "no-sidebar", "main-content has-header", "post-with-ads", "social-science", "comment-policy",
    ):
        for page in (f"<div class='{names}'>{paragraphs}</div>", f"<div id={names.split()[0]}>{paragraphs}</div>"):
            assert html_text.main_text(f"<html><body>{around.format(page)}</body></html>").split("\n") == said
    nested = f'<form id="aspnetForm"><div class="social-science">{paragraphs}</div></form>'
    assert html_text.main_text(f"<body>{around.format(nested)}</body>").split("\n") == said


def test_named_parts_go_where_other_text_is_left():
    remark = "<p>" + "I have a lot to say about this, as always, dear all. " * 8 + "</p>"
    page = f"<body><div><p>{'The article is short but it is one. ' * 4}</p></div><div class=comments>{remark * 3}</div></body>"
    assert html_text.main_text(page) == " ".join(["The article is short but it is one."] * 4)
    assert html_text.main_text("<body><div class=cookie-notice>We use cookies.</div></body>") == ""
    assert html_text.main_text("<body><form><p>Your name</p></form><p>Text of the page.</p></body>") == "Text of the page."


@pytest.mark.parametrize("tag", ["<span>", "<b>", "</b>", "<div>", "<li>", "<td>", "<p>", "<dt><b>", "<a <b", "<script>", "<!--"])
def test_main_text_is_linear_in_tags(tag):
    import time

    begin = time.perf_counter()
    html_text.main_text("<body><p>one</p>" + tag * 100_000 + "deep")
    assert time.perf_counter() - begin < 8


def test_main_text_columns(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>a\n b</p>", "t"), (3, "<p>a\n b</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    got = [(r.page_id, r.main_text) for r in html_text.extract(pages).collect()]
    assert sorted(got) == [(1, ""), (2, ""), (3, "a b"), (3, "a b")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_words_through_the_library():
    with open(P.path("word_bpe_49k.json"), "rb") as file:
        ids = token_files.WordIds(file.read())
    special = ["<|endoftext|>", "a<|STARTOFTEXT|> b", "Σς ΑΣ", "DON'T", "é́x"]
    for text in some_texts(5, 1500) + special:
        exact = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.packed(text), "<u2").tolist() == exact


def test_records_tell_of_damage():
    made = token_files.frame(token_files.payload_of(7, np.array([1, 70_000]), 4)) + b"\n"
    (offset, doc, ids), = token_files.records(made)
    assert (offset, doc, ids.tolist()) == (0, 7, [1, 70_000])
    for at in range(len(made) - 1):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.records(bytes(broken)))


def test_token_files(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    token_files.write(odd_docs, str(tmp_path), path, records_per_file=2)
    rows = token_files.positions(token_files.read(spark, str(tmp_path), with_ids=True)).orderBy("start").collect()
    library, start = Tokenizer.from_file(path), 0
    expected = sorted(
        ((r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )
    assert [r.key for r in rows] == [k for k, _ in expected]
    for row, (_, text) in zip(rows, expected, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_ids, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = token_files.read_some(spark, str(tmp_path), spark.createDataFrame([(3,), (9,)], "doc_id long"))
    assert [r.doc_id for r in some.collect()] == [3, 3]


def test_token_files_are_in_order_whatever_their_names(spark, tmp_path):
    """The random letters in a file's name may hold ``-c`` and digits."""
    names = [f"part-0000{part}-fb5c8e83-5f6e-4c0a-9b1c-c0c262e9e811-c00{piece}.txt" for part in (1, 0) for piece in (1, 0)]
    for n, name in enumerate(names):
        (tmp_path / "records").mkdir(exist_ok=True)
        made = [token_files.frame(token_files.payload_of(10 * n + i, np.arange(n + 1), 2)) for i in range(2)]
        (tmp_path / "records" / name).write_bytes(b"".join(m + b"\n" for m in made))
    read = token_files.read(spark, str(tmp_path))
    index = read.select("file", "n_ids")
    for rows in (token_files.positions(read), token_files.positions(read, index)):
        found = [(r.key, r.start) for r in rows.orderBy("start").collect()]
        assert found == [(30, 0), (31, 4), (20, 8), (21, 11), (10, 14), (11, 16), (0, 18), (1, 19)]


def test_token_files_written_again_and_again(spark, tmp_path):
    docs = spark.createDataFrame([(None if i < 6 else i, f"w{i % 4} é") for i in range(12)], "doc_id long, text string")
    for turn in range(20):
        folder = f"{tmp_path}/{turn}"
        token_files.write(docs, folder, P.path("word_bpe_49k.json"), records_per_file=2)
        rows = token_files.positions(token_files.read(spark, folder), spark.read.parquet(f"{folder}/index"))
        rows = rows.orderBy("start").collect()
        assert [r.key for r in rows] == [None] * 6 + list(range(6, 12))
        assert [r.start for r in rows] == [sum(r.n_ids for r in rows[:i]) for i in range(12)]


def test_resolving_repeats_takes_one_exchange(spark):
    import re

    rows = spark.createDataFrame([(1, 2, 3, 0, 0, 0, 0, 1, 1, 0)], substring.ROW)
    plan = substring.resolve(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1


def plain_hits(text, items, window=13):
    import re

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    doc, hit, found = words(text), set(), set()
    for item, said in items:
        said = words(said)
        for i in range(max(1, len(said) - window + 1) if said else 0):
            part = said[i : i + window]
            for j in range(len(doc) - len(part) + 1):
                if doc[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choices(["a", "B", "cé", "d1"], k=n))
    items = [(i, say(rnd.randrange(20))) for i in range(12)] + [(3, "x y"), (3, "x y"), (20, None), (21, "?!")]
    texts = [None, "", "X, Y. z", *(f"{say(9)}; {rnd.choice(items)[1]} -{say(5)}" for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.verdicts(decontaminate.scan(docs, bench, block_bytes=block_bytes)).collect()
    for row in rows:
        n, hit, found = plain_hits(row.text, items)
        assert (row.n_words, row.n_hit, row["items"]) == (n, hit, found)
        assert row.contaminated == (hit > 0 and 20 * hit >= n)
        spans = [row.text[h.start : h.stop] for h in row.hits]
        assert sum(len(decontaminate.words_of(s.encode())) for s in spans) == hit
    assert decontaminate.scan(docs, bench.limit(0)).where("n_words > 0 and size(hits) = 0").count() == 41
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, None),
        "nothing": ("", "", None, None),
        "http://A.Example.org/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/10": ("example.org", "/en/10", "example.org/en/1", "block"),
        "a://b.ORG/es/": ("b.org", "/es/", "org/", "allow"),
        "x://org?/a": ("org", "", None, None),
        "x://xcom/de/": ("xcom", "/de/", None, None),
        "x://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
        "x://y.com/fr/://": ("y.com", "/fr/://", "com/fr/", "allow"),
    }
    pages = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("host", F.lit("old"))
    for row in url_filter.judge(pages).collect():
        host, path, rule, verdict = cases[row.url]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 40, 300, 5000])
def test_smallest_by_hash(spark, most):
    """The bound before the sort changes nothing, also where one row stands for most of the table."""
    rows = spark.range(4000).select((F.col("id") % 1700).alias("a"), (F.col("id") % 2).alias("b"))
    rows = rows.unionByName(spark.range(20_000).select(F.lit(3).cast("long").alias("a"), F.lit(1).cast("long").alias("b")))
    got = [tuple(r) for r in batches.smallest_by_hash(rows, ["a"], most).collect()]
    assert got == [tuple(r) for r in rows.distinct().orderBy(F.xxhash64("a"), "a", "b").limit(most).collect()]
    assert batches.smallest_by_hash(rows.limit(0), ["a"], most).count() == 0


def test_url_model_on_held_out_rows():
    rnd = random.Random(7)
    rows = [
        (f"{rnd.choice(['casino', 'bets', 'win'])}{rnd.randrange(99)}.com", "/a", True) if i % 2
        else (f"{rnd.choice(['news', 'school', 'park'])}{rnd.randrange(99)}.com", "/a", False)
        for i in range(400)
    ]
    model = url_filter.fit(rows[:200])
    assert sum((model.probability(h, p) >= 0.5) == b for h, p, b in rows[200:]) >= 195


def plain_best(rows, queries, k):
    out = []
    for q, v in queries:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("size", "most"), [(5, 3), (300, 2), (300, 10**9)])
def test_topk(spark, size, most):
    rnd = random.Random(size)
    rows = [(i, [rnd.randint(-most, most) for _ in range(6)]) for i in range(size)]
    bad = [(1000, None), (1001, [1, None, 1, 1, 1, 1]), (None, [1] * 6), (1002, [1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, vector array<long>")
    found = topk.search(df, df.where("vec_id % 20 = 0"), k=7, block=64)
    assert sorted(map(tuple, found.collect())) == plain_best(rows, rows[::20], 7)
    assert topk.search(df.limit(0), df).count() == 0 == topk.search(df, df.limit(0)).count()


def test_topk_of_repeated_rows(spark):
    """Repeated queries give their results once; all rows of a repeated key are candidates."""
    rnd = random.Random(12)
    rows = [(i, [rnd.randint(-9, 9) for _ in range(6)]) for i in range(100)]
    asked = rows[::20] + [(40, [9, -9, 9, -9, 9, -9])]
    rows += rows[::20] * 2 + [asked[-1]] + [(7, rows[7][1])] * 150 + [(7, [rnd.randint(-9, 9) for _ in range(6)]) for _ in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    found = topk.search(df, df.where("vec_id % 20 = 0"), k=7, block=64)
    assert sorted(map(tuple, found.collect())) == plain_best(rows, asked, 7)


def test_topk_deals_one_key_to_all_blocks(spark):
    rows = spark.createDataFrame([(7, [i, i % 3]) for i in range(600)], "id long, v array<long>")
    sizes = [r["count"] for r in rows.groupBy(topk.block_of(F.lit(10))).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 120


def test_topk_of_vectors_of_several_lengths(spark):
    """Each length is searched by itself; no row is left out for being of a rare one."""
    rnd = random.Random(5)
    rows = [(i, [rnd.randint(-9, 9) for _ in range((0, 2, 3, 3, 3)[i % 7 % 5])]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0"), k=7, block=64).collect()))
    want = []
    for width in (0, 2, 3):
        alike = [r for r in rows if len(r[1]) == width]
        want += plain_best(alike, [r for r in alike if r[0] % 20 == 0], 7)
    assert got == sorted(want)


def test_topk_stops_by_its_bounds():
    """On skewed vectors a query reads a small part of its lists, on even ones all; results are the same."""
    rng = np.random.default_rng(3)
    even = rng.integers(-60, 60, (4000, 16))
    skewed = even * (rng.random((4000, 1)) ** -1.5).clip(1, 2000).astype(np.int64)
    for vectors, most in ((skewed, 1 / 16), (even, 1)):
        ids = rng.permutation(4000)
        lists = topk.SortedLists(ids, vectors.astype(np.float64), np.ones(4000, np.int64))
        queries = even[:40].astype(np.float64)
        asked, chosen, scores, read = topk.best(ids[:40], queries, lists, 20)
        assert np.median(read) <= most * 4000
        for q in range(40):
            exact = lists.vectors @ queries[q]
            exact[lists.ids == ids[q]] = -np.inf
            order = np.lexsort((lists.ids, -exact))[:20]
            assert (chosen[asked == q] == order).all() and (scores[asked == q] == exact[order]).all()


def test_topk_bounds_hold_at_every_depth():
    rng = np.random.default_rng(4)
    vectors, queries = rng.integers(-9, 9, (90, 5)).astype(np.float64), rng.integers(-3, 3, (7, 5)).astype(np.float64)
    reading = topk.Reading(topk.SortedLists(np.arange(90), vectors, np.ones(90, np.int64)), queries)
    exact = queries @ vectors.T
    for depth in (2, 3, 10, 45, 89, 90):
        reading.advance(depth)
        lower, upper = reading.bounds()
        assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower == exact).all() and (upper == exact).all()


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([None, 1.0],), (None,)], "e array<float>")
    assert [r.v for r in topk.quantised(df, "e", "v").collect()] == [[32, -1], None, None, None]


def plain_components(links, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return root


@pytest.mark.parametrize("count", [0, 15, 120])
def test_components(spark, count):
    rnd = random.Random(count)
    links = [(rnd.randrange(100), rnd.randrange(100)) for _ in range(count)] + [(i, i + 1) for i in range(200, 200 + count)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.connected(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in plain_components(links, {n for e in links for n in e}).items() if n in nodes}


def test_fingerprint_by_spark_hashes(spark):
    for text in ("One two three two ONE two three", "é x", "a\x1cb c d", "a b c d e f g"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]).decode() for i in range(max(1, len(words) - 2))]
        hashed = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
        exact = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
        assert simhash.fingerprint_of(text.encode()) == exact
    assert simhash.fingerprint_of(b" \n") == 0


@pytest.mark.parametrize("crowd", [2, 32])
def test_links_join_what_is_near(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(crowd)
    prints = {0, 1 << 63}
    for _ in range(12):
        base = rnd.getrandbits(64)
        prints |= {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    near = lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 2
    exact = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    got = [tuple(r) for r in simhash.links(df).collect()]
    assert all(near(a, b) for a, b in got)
    assert plain_components(got, signed) == plain_components(exact, signed)


def test_near_copies(spark, odd_docs):
    rows = simhash.near_copies(odd_docs).collect()
    assert len(rows) == 7
    ids = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert ids[1] == ids[2] == ids[4] == (0, 1) and ids[3][1] == 3 == ids[None][1]
    assert simhash.near_copies(odd_docs.limit(0)).count() == 0


def test_quality_tells_grades_apart(spark):
    rnd = random.Random(8)
    words = {0: ["awful", "scum"], 1: ["meh", "so"], 2: ["fine", "good"]}
    say = lambda g: " ".join(rnd.choices(words[g] + ["the", "of", "and"], k=30))
    rows = [(i, say(i % 3), i % 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(docs, docs.select("doc_id", "grade").where("doc_id < 300"))
    assert model.thresholds[0] < model.thresholds[1]
    scored = quality.accepted(quality.score(docs.where("doc_id >= 300"), model)).collect()
    assert sum((r.accepted == (r.grade == 2)) for r in scored) >= 295
    assert all(abs(r.expected_grade - sum(r.tails)) < 1e-9 and r.tails[0] >= r.tails[1] for r in scored)


def test_quality_of_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.train(odd_docs, none)
    assert quality.score(odd_docs, model).where("size(tails) = 2").count() == 7
    odd = spark.createDataFrame([(3, 1), (3, 0), (5, None), (5, 9), (77, 1), (None, 1)], "doc_id long, grade int")
    assert quality.score(odd_docs.limit(0), quality.train(odd_docs, odd)).count() == 0


def greedy(word, first, further):
    at = n = 0
    while at < len(word):
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in (further if at else first)), None)
        if stop is None:
            return -1
        at, n = stop, n + 1
    return n


def test_word_pieces_by_greedy_matching():
    rnd = random.Random(9)
    for _ in range(600):
        first, further = ({bytes(rnd.choices(b"abc", k=rnd.randrange(1, 5))) for _ in range(rnd.randrange(8))} for _ in "12")
        automaton = word_pieces.Automaton(sorted(first), sorted(further))
        for _ in range(20):
            word = bytes(rnd.choices(b"abc", k=rnd.randrange(9)))
            assert automaton.count(word) == greedy(word, first, further)


def spaced(word, first, further):
    """The same on the word with a space before it, as the vocabulary file has it."""
    text, at, n = b" " + word, 0, 0
    known = further | {b" " + f for f in first}
    while at < len(text):
        stop = next((j for j in range(len(text), at, -1) if text[at:j] in known), None)
        if stop is None:
            return -1
        at, n = stop, n + 1
    return n


def test_word_pieces_begin_with_the_lone_space_where_no_other_piece_does():
    first, further = word_pieces.vocabulary([b" ", b" a", b" ab\n", b"  b", b"b", b"bc", b"\xd1"])
    assert (sorted(first), sorted(further)) == ([b"", b"a"], [b"b", b"bc", b"\xd1"])
    rng = random.Random(4)
    for _ in range(300):
        further = {bytes(rng.choices(b"abc", k=rng.randint(1, 3))) for _ in range(rng.randint(0, 6))}
        first = {bytes(rng.choices(b"abc", k=rng.randint(1, 3))) for _ in range(rng.randint(0, 3))} | {b""}
        automaton = word_pieces.Automaton(sorted(first), sorted(further))
        for _ in range(20):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            assert automaton.count(word) == spaced(word, first, further)


def test_word_pieces_of_words_in_other_scripts():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        tokens = list(byte_pairs.read_ranks(file.read()))
    first, further = word_pieces.vocabulary(tokens)
    automaton, starts, parts = word_pieces.Automaton(first, further), set(first), set(further)
    for word in ("русский", "你好世界", "😀😀", "été", "word"):
        count = automaton.count(word.encode())
        assert count == spaced(word.encode(), starts, parts)
    assert automaton.count("русский".encode()) > 1 and automaton.count("你好世界".encode()) > 4


def test_word_pieces_columns(spark, odd_docs):
    got = word_pieces.count_pieces(odd_docs, "text", [b"one", b"ab"], [b"x"]).collect()
    assert sorted((r.n_words, r.n_pieces) for r in got) == [(0, 0)] * 3 + [(2, 2)] * 3 + [(40_000, 40_000)]


def plain_removal(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(s[i : i + window]) for s in split for i in range(len(s) - window + 1))
    out = []
    for words in split:
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [1, 3, 7, 35])
def test_substring_removal(spark, window):
    rnd, texts = random.Random(window), [None, "", "a\x1cb"]
    for _ in range(120):
        words = [rnd.choice("abcdefgh"[: rnd.choice([2, 8])]) + rnd.choice(["", "1", "é"]) for _ in range(rnd.randrange(12 * window + 5))]
        if rnd.random() < 0.6:
            old = (rnd.choice(texts) or "").split()
            i, at = rnd.randrange(len(old) + 1), rnd.randrange(len(words) + 1)
            words[at:at] = old[i : i + rnd.randrange(3 * window + 2)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, window)


def test_substring_removal_with_crowds(spark, monkeypatch):
    """One passage in many surroundings, more than a batch compares."""
    monkeypatch.setattr(substring, "CROWD", 2)
    rnd = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(str(rnd.random()) for _ in range(rnd.randrange(60)))} {passage} {rnd.random()}" for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()}
    assert [got[i] for i in range(50)] == plain_removal(texts, 35)


def test_substring_windows_of_batches_in_any_order(spark):
    """A window in three surroundings, in batches whose documents stand in descending order."""
    said = "1 2 3 4 5 6 7 "
    batches = [[(30, said + "B"), (1, said + "A")], [(20, said + "A"), (2, said + "B")], [(40, said + "X")]]
    schema = "doc long, text string, firsts array<int>, lasts array<int>, ats array<int>, whole boolean"
    listed = spark.sparkContext.parallelize(batches, 3).flatMap(lambda batch: batch)
    marked = spark.createDataFrame(listed.map(lambda r: (*r, [0], [1], [3], True)), schema)
    rows = substring.resolve(substring.extended(marked, 2, 4, 7))
    found = {(r.doc, i) for r in substring.repeated_windows(rows).collect() for i in range(r["first"], r["last"] + 1)}
    assert found == {(1, 0), (1, 1), (2, 0), (2, 1), (20, 0), (20, 1), (30, 0), (30, 1), (40, 0)}


def test_substring_removal_of_odd_rows(spark, odd_docs):
    rows = substring.remove_repeats(odd_docs, window=2).collect()
    assert len(rows) == 7 and set(odd_docs.columns) < set(rows[0].asDict())
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(0, 0)] * 3 + [(2, 2)] * 3 + [(40_000, 40_000)]
    assert substring.remove_repeats(odd_docs.limit(0)).count() == 0


def test_sha_of_lists(spark):
    row = spark.range(1).select(F.sha2(F.array_join(F.array(F.lit(5), F.lit(17)).cast("array<string>"), ","), 256)).head()
    assert row[0] == hashlib.sha256(b"5,17").hexdigest()
