import pytest
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute

from densel.llm import extraction as x

SCHEMA = "page_id long, url string, html string, text string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "h") for i, u, h in rows], SCHEMA)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>";</script></head>
    <body><nav><ul><li><a href="/a">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
    <article><h1>Head&nbsp;line</h1><p><b>One &lt;two&gt;<br>three<p>Four<i>teen</i> &copy; &am x</p>
    <form><input value=">"><p>Sign up</p></form><aside>Side</aside><div class="share-buttons">Tweet</div><p title="a > b">Five</p>
    <section class="comments"><p>Reader</p></section></article><div>After</div><footer>&copy; foot</footer></body>"""
    kept = [t for kind, t in x.blocks_of(page) if kind == x.KEPT]
    assert kept == ["Head line", "One <two> three", "Fourteen © &am x", "Five"]
    assert [t for kind, t in x.blocks_of(page) if kind == x.LOOSE] == ["After"]


def test_broken_markup():
    open_menu = "<nav><ul><li>Menu<article><p>Text"
    assert [b for b in x.blocks_of(open_menu) if b[0] == x.KEPT] == [(x.KEPT, "Text")]
    assert x.blocks_of("a < b and <b>c</b") == [(x.LOOSE, "a < b and c")]
    assert x.blocks_of("<script>never closed <p>x") == []
    assert x.blocks_of("<div hidden><p>secret</p></div><p>seen</p>") == [(x.DROPPED, "secret"), (x.LOOSE, "seen")]
    assert x.blocks_of("") == []


def test_repeated_against_brute_force():
    rng = random.Random(5)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(12)]
    streams += [streams[0], list("xyzxyzxyz")]
    content = [0, *range(1, 12), 0, 13]
    got = x.repeated(streams, content, 4)
    where = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - 3):
            where.setdefault(tuple(s[i:i + 4]), set()).add(content[p])
    for s, covered in zip(streams, got, strict=True):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 3):
            if len(where[tuple(s[i:i + 4])]) > 1:
                want[i:i + 4] = True
        assert covered.tolist() == want.tolist()


def test_pages_without_article(spark):
    menu, foot = "Home News Sport About Contact", "All rights reserved by the owner"
    body = [f"This page tells about topic {w} in words of its own" for w in ("alpha", "beta", "gamma")]
    rows = [(i, f"http://www.a.org/{i}", f"<div>{menu}</div><div>{b}</div><div>{foot}</div>") for i, b in enumerate(
        ["one quick fox ran", "two slow dogs slept", "three birds sang songs"])]
    rows += [(3, "http://b.org/x", f"<div>{menu}</div><p>{body[0]}</p>"), (3, "http://b.org/x", f"<div>{menu}</div><p>{body[0]}</p>")]
    rows += [(4, "http://www.a.org/4", f"<nav>{menu}</nav><main><p>{foot}</p><p>{body[1]}</p></main>")]
    rows += [(5, None, None), (6, "no scheme", ""), (None, "http://c.org", "<p>x y</p>"), (7, "http://c.org", "<nav>only menu</nav>")]
    out = x.extract(pages(spark, rows))
    got = sorted((str(r.page_id), r.text) for r in out.collect())
    assert got == sorted([("0", "one quick fox ran"), ("1", "two slow dogs slept"), ("2", "three birds sang songs"),
                          ("3", f"{menu}\n\n{body[0]}"), ("3", f"{menu}\n\n{body[0]}"), ("4", f"{foot}\n\n{body[1]}"),
                          ("5", ""), ("6", ""), ("None", "x y"), ("7", "")])


def test_large_host_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(x, "ARRAY_TOKENS", 200)
    menu = "Home News Sport About Contact"
    rows = [(i, "http://a.org/", f"<div>{menu}</div><div>own{i} words{i} here{i}</div>") for i in range(300)]
    got = {r.page_id: r.text for r in x.extract(pages(spark, rows)).collect()}
    assert got == {i: f"own{i} words{i} here{i}" for i in range(300)}


def test_long_and_no_pages(spark):
    assert x.extract(pages(spark, [])).collect() == []
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert len(x.extract(pages(spark, [(1, "http://a", long)])).first().text) == 20_000 * 13 - 2


def host_rows(n=40):
    """Pages whose notice is on few or many pages of one large host, in loose text and in articles."""
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(10 ** 9))
    own = lambda k: " ".join(word() for _ in range(k))
    rare, common, advert = own(9), own(12), own(10)
    rows, want = [], {}
    for i in range(n):
        a, b, c = own(12), own(15), own(20)
        if i % 2:
            page, text = f"<div>{a}</div>" + (f"<div>{common}</div>" if i % 3 else "") + f"<p>{b}</p>", [a, b]
        else:
            page, text = f"<article><p>{a}</p><p>{advert}</p><p>{b}</p></article><div>{c}</div>", [a, b, c]
        if i < 2:
            page, text = page + f"<section>{rare}</section>", [*text, rare]
        rows.append((i, "http://large.org/", page))
        want[i] = "\n\n".join(text)
    return rows, want


def test_arrays_of_a_host_decide_together(spark, monkeypatch):
    rows, want = host_rows()
    for size in (500_000, 150, 20):
        monkeypatch.setattr(x, "ARRAY_TOKENS", size)
        assert {r.page_id: r.text for r in x.extract(pages(spark, rows)).collect()} == want
    # three pages of which two share a notice, each page in an array of its own
    few = [(i, "http://few.org/", f"<div>{'n o t i c e' if i else 'q'}</div><div>own{i}</div>") for i in range(3)]
    for size in (500_000, 1):
        monkeypatch.setattr(x, "ARRAY_TOKENS", size)
        got = {r.page_id: r.text for r in x.extract(pages(spark, few)).collect()}
        assert got == {0: "q\n\nown0", 1: "own1", 2: "own2"}


def test_arrays_see_articles_and_text_beside_them(spark):
    rng = random.Random(4)
    own = lambda k: " ".join("w" + str(rng.randrange(10 ** 9)) for _ in range(k))
    advert, quote = own(11), own(30)
    teasers = [own(10) for _ in range(3)]
    rows, want = [], {}
    for i in range(12):
        story = own(40)
        if i < 6:
            cards = "".join(f"<article>{t}</article>" for t in teasers)
            rows.append((i, "http://a.org/", f"<div><p>{story}</p></div>{cards}"))
            want[i] = story
        else:
            cited = quote if i < 8 else own(30)
            rows.append((i, "http://a.org/", f"<article><p>{story}</p><p>{advert}</p><p>{cited}</p></article>"))
            want[i] = f"{story}\n\n{cited}"
    near = own(60)
    rows += [(20 + i, "http://copies.org/", f"<article>{near} number{i}</article>") for i in range(8)]
    want |= {20 + i: f"{near} number{i}" for i in range(8)}
    assert {r.page_id: r.text for r in x.extract(pages(spark, rows)).collect()} == want


def test_phrases_stay_on_large_hosts(spark):
    rng = random.Random(6)
    own = lambda k: " ".join("w" + str(rng.randrange(10 ** 9)) for _ in range(k))
    phrases = [own(6) for _ in range(10)]
    shared = own(14)
    texts = [f"{own(9)} {phrases[i % 10]} {own(9)} {phrases[(i + 3) % 10]}" + (f" {shared}" if i < 3 else "") for i in range(60)]
    rows = [(i, "http://a.org/", f"<p>{t}</p>") for i, t in enumerate(texts)]
    assert {r.page_id: r.text for r in x.extract(pages(spark, rows)).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("html,text", [
    ('<article class="post has-sidebar"><p>Text</p></article>', "Text"),
    ('<main id="content-with-sidebar">Text</main>', "Text"),
    ('<div class="page header-fixed">menu<article>Text</article>foot</div>', "Text"),
    ("<article>Intro <svg/>rest</article>", "Intro rest"),
    ("<article>a <svg><text>no</text></svg>b</article>", "a b"),
    ("<article>a <button>b</article>", "a b"),
    ("<article>a <button>no</button>b</article>", "a b"),
    ("<article>a <math><mi>x</mi></math> b</article>", "a x b"),
    ('<article>x<p class="advert">Buy now</p>y<li class="cookie-notice">ok<li>z</article>', "x\n\ny\n\nz"),
    ('<article>x<p class="advert">Buy<p>stay</article>', "x\n\nstay"),
    ('<article>x<p class="header">Part one</p></article>', "x\n\nPart one"),
    ('<div class="comments"><article class="comment">no</article></div><article>yes</article>', "yes"),
    ('<article>t<section class="comments"><article>no</article></section>u</article>', "t\n\nu"),
])
def test_class_words_and_open_tags_lose_no_article(html, text):
    from densel.llm.extraction import KEPT, blocks_of
    assert "\n\n".join(t for kind, t in blocks_of(html) if kind == KEPT) == text


def test_tokens_of_an_array_are_hashed_once(monkeypatch):
    rows = [{"page_id": i, "url": "", "host": "h", "content": i, "array": 0, "arrays": 2, "kinds": bytes([x.KEPT, x.LOOSE]), "pages": 8,
             "blocks": [f"a b c d e f g h i{i} j k", "l m n o p q r s"]} for i in range(4)]
    hashed = []
    blake2b = x.hashlib.blake2b
    monkeypatch.setattr(x.hashlib, "blake2b", lambda t, **o: hashed.append(t) or blake2b(t, **o))
    found = x._candidates(pa.Table.from_pylist(rows, schema=x._STREAMS.append(pa.field("pages", pa.int64()))))
    assert set(found.column("rule").to_pylist()) == {0, 1, 2}
    assert len(hashed) == len(set(hashed)) > 0


def test_among_is_membership():
    rng = np.random.default_rng(2)
    keys, asked = rng.integers(-50, 50, 300), rng.integers(-60, 60, 20)
    assert (x.among(keys, asked) == np.isin(keys, asked)).all()
    assert not x.among(keys, asked[:0]).any() and not len(x.among(keys[:0], asked))


def test_blocks_of_large_hosts_are_shuffled_once(spark, monkeypatch):
    rows, want = host_rows()
    monkeypatch.setattr(x, "ARRAY_TOKENS", 150)
    out = x.extract(pages(spark, [*rows, (99, "http://small.org/", "<p>small</p>")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # only hosts of one array meet in a shuffle; the arrays are cut where their table lies
    assert "hashpartitioning(host" in plan and not re.search(r"hashpartitioning\(host#\d+, array#", plan)
    assert {r.page_id: r.text for r in out.collect()} == want | {99: "small"}


def test_many_runs_meet_their_arrays_by_host(spark, monkeypatch):
    rows, want = host_rows()
    monkeypatch.setattr(x, "ARRAY_TOKENS", 150)
    monkeypatch.setattr(x, "BROADCAST_RUNS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = x.extract(pages(spark, rows))
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id: r.text for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_are_packed_and_unpacked(monkeypatch):
    schema = pa.schema([*list(x._STREAMS)[:6], pa.field("html", pa.string())])
    menu = " ".join(f"w{i}" for i in range(300))
    rows = [{"page_id": i, "url": None if i == 3 else f"u{i}", "host": f"h{i % 2}", "content": 90 if i in (4, 6, 8) else i, "array": 0,
             "arrays": 1, "html": None if i == 5 else "<p> </p>" if i == 7 else f"<p>{menu}<p>é{90 if i in (4, 6, 8) else i}\n b"} for i in range(40)]
    parsed = []
    blocks_of = x.blocks_of
    monkeypatch.setattr(x, "blocks_of", lambda page: parsed.append(page) or blocks_of(page))
    for limit, n_parts, n_parsed in ((x.PART_CHARS, 2, 38), (1, 40, 40)):
        monkeypatch.setattr(x, "PART_CHARS", limit)
        parsed.clear()
        parts = pa.Table.from_batches(x._parts(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])))
        assert (parts.num_rows, len(parsed)) == (n_parts, n_parsed)
        for host in ("h0", "h1"):
            group = x.unpacked(parts.filter(pa.compute.equal(parts.column("host"), host)))
            again = x.unpacked(pa.Table.from_pylist([x.packed(group.to_pylist())], schema=x._PARTS)).to_pylist()
            mine = [r for r in rows if r["host"] == host]
            assert [(r["page_id"], r["url"], r["content"]) for r in again] == [(r["page_id"], r["url"], r["content"]) for r in mine]
            seen = set()
            for r, given in zip(again, mine, strict=True):
                blocks = blocks_of(given["html"] or "")
                first = r["content"] not in seen
                seen.add(r["content"])
                assert r["blocks"] == ([t for _, t in blocks] if first else None)
                assert r["kinds"] == (bytes(k for k, _ in blocks) if first else None)
        if n_parts == 2:
            assert sum(map(len, parts.column("texts").to_pylist())) < 5 * len(menu)
