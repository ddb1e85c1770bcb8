import base64
import glob
import hashlib
import struct

import numpy as np
import pytest
import zstandard

from sifter.llm import htmltext, urls, warc
from sifter.llm.common import scratch_path

ODD = [(1, None, None), (2, "", ""), (3, "http://a.example.org/x", "<p>same"), (4, "http://b.example.org/y\nz", "<p>same"), (None, "no url", "<p>same"),
       (5, "https://H.Example.COM", "plain text &amp; more"), (6, "ftp://example.org/es/1?q#f", "<article><p>a<p>b" + "<p>long text</p>" * 3000)]


@pytest.fixture(scope="module")
def pages(llm):
    return llm.createDataFrame([(*r, "clash") for r in ODD], "page_id long, url string, html string, sha string")


def test_warc_round_trip(llm, pages):
    folder = scratch_path(llm, "warc-test")
    manifest = warc.write_archives(pages, folder)
    rows = warc.read_archives(manifest, folder, payloads=True).collect()
    assert len(rows) == len(ODD)
    by = {r["page_id"]: r for r in rows}
    for page, _, html in ODD:
        data = (html or "").encode()
        r = by[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        first = max(p for p, _, h in ODD if p is not None and (h or "") == (html or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))
        assert r["payload"] == (data if page == first else b"")
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_warc_dictionary_frame_and_torn_files(llm, tmp_path):
    rng = np.random.default_rng(1)
    page = lambda: ("<html><body>" + " ".join(f"word{w}" for w in rng.integers(0, 400, 300)) + "</body></html>").encode()
    w = warc.ArchiveWriter(str(tmp_path), "one")
    records = [warc.record(str(i), None, p := page(), warc.digest(p), None) for i in range(1500)]
    for r in records:
        w.add(r)
    path, n = w.close()
    assert n == 1500 and not glob.glob(str(tmp_path / ".*"))
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and zstandard.ZstdCompressionDict(data[8:8 + size]).dict_id()
    assert list(warc.read_archive(str(tmp_path), path)) == records
    open(tmp_path / "torn.warc.zst", "wb").write(data[:-20])
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path), str(tmp_path / "torn.warc.zst")))


def test_url_rules_and_method(llm, pages):
    got = {r["page_id"]: r for r in urls.judge(pages, urls.labelled_urls(llm)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None) and got[None]["host"] == ""
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("h.example.com", "", None)
    assert (got[6]["host"], got[6]["path"], got[6]["rule"], got[6]["verdict"]) == ("example.org", "/es/1", "example.org/es/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("org/", "allow")
    more = ["https://x.casino-win.example.net/en/5", "http://blog.ththst.example.net/fr/5", "http://sub.example.org/en/1x", "http://example.org/en/2", "http://notexample.org/es/1"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(llm.createDataFrame(list(enumerate(more)), "page_id long, url string"), urls.labelled_urls(llm)).collect()}
    assert got == {0: (None, "block"), 1: (None, "allow"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("org/", "allow")}
    assert urls.judge(pages.limit(0), urls.labelled_urls(llm)).count() == 0


def test_url_method_on_unseen_hosts(llm):
    """Hosts that the labelled table doesn't have; the last of each row look like the other kind."""
    block = ["royal-slots-casino", "pokerbonus", "lottery-jackpot", "payday-credit", "adult-movies-xxx", "meds-no-rx", "spamlink-farm", "ads-tracker"]
    allow = ["betterhomes", "trackandfield", "classroom-news", "nation-history", "farmhouse-cheese", "adelaide-museum", "credible-research", "windmill-garden"]
    listed = {*urls.BLOCKED_HOSTS, *urls.ALLOWED_HOSTS}
    assert not listed & {*block, *allow}
    rows = [(i, f"https://{'www.' * (i % 2)}{h}.example.com/en/{i}") for i, h in enumerate(block + allow)]
    got = {r["page_id"]: r for r in urls.judge(llm.createDataFrame(rows, "page_id long, url string"), urls.labelled_urls(llm), rules=()).collect()}
    wrong = [(block + allow)[i] for i in got if (got[i]["verdict"] == "block") != (i < len(block))]
    assert not wrong


def test_url_scores_are_the_fitted_models(llm):
    """The sum of weights per page equals the model's own prediction on the same buckets."""
    weights, intercept = urls.train(urls.labelled_urls(llm))
    made = [(i, f"https://host{i}.example.com/en/{i}") for i in range(20)] + [(50, None), (51, "x" * 50_000 + "://" + "y" * 50_000), (52, "no scheme")]
    pages = llm.createDataFrame(made + made[:3], "page_id long, url string")
    got = urls.judge(pages, urls.labelled_urls(llm)).collect()
    grams = pages.select("page_id", urls.F.array_distinct(urls.F.transform(urls.grams(urls.host_of(urls.F.col("url")), urls.path_of(urls.F.col("url"))), urls._bucket)).alias("b"))
    want = {r["page_id"]: 1 / (1 + np.exp(-(intercept + sum(weights[i] for i in r["b"])))) for r in grams.collect()}
    assert len(got) == len(made) + 3 and all(abs(r["block_probability"] - want[r["page_id"]]) < 1e-9 for r in got)
    assert len(weights) == urls.DIMS


def test_blocks_of_messy_html():
    page = "<!-- x <p> --><style>p{}</style><div class='Ad Box'>buy</div><p>one <b>t&amp;wo</b>\n three<br>four<p>five<script>var a='</p>'</script> six</p><a href='#'>l</a><!-- open <p>gone"
    found = htmltext.blocks(page)
    assert [b.text for b in found] == ["buy", "one t&wo three four", "five six", "l"]
    assert found[0].path == ("div", "ad", "box") and found[3].linked == 1
    assert htmltext.blocks(None) == htmltext.blocks("") == htmltext.blocks("<p></p>") == []


def test_custom_elements_are_no_raw_text():
    for tag in ("svg-icon", "style-guide", "template-x", "select-box"):
        page = f"<article><p>one</p><{tag} name='x'></{tag}><p>two</p><{tag}/><p>three</p></article><svg><text>no</text></svg><script\n>no</script><p>four</p>"
        assert [b.text for b in htmltext.blocks(page)] == ["one", "two", "three", "four"]


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    model = htmltext.Labeller()
    pages = [rng.random((n, htmltext.INPUT)).astype(np.float32) for n in (3, 5)]
    x, mask = htmltext.padded(pages)
    alone = [model.margins(*htmltext.padded([p]))[0][:, 0] for p in pages]
    together = model.margins(x, mask)[0]
    for col, z in enumerate(alone):
        assert np.allclose(together[:len(z), col], z, atol=1e-5)      # padding changes nothing
    y = [(np.arange(len(p)) % 2).astype(np.float32) for p in pages]
    model.fit(pages, y, epochs=150)
    assert all((m == (t > 0.5)).all() for m, t in zip(model.content(pages), y))


def test_training_on_pages_without_article_and_with_comments_inside():
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 500, n))

    def page(i):
        body = [words(8), *(words(rng.integers(15, 60)) for _ in range(4))]
        main = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
        inner = f'<div class="ad">{words(5)}</div><section class="comments"><p>{words(9)}</p><p>{words(20)}</p></section>' if i % 3 == 1 else ""
        main = f'<div class="content">{main}</div>' if i % 3 == 0 else f"<article>{main}{inner}</article>"
        return f'<html><head><title>{words(3)}</title></head><body><nav><ul><li><a href="/">{words(1)}</a></li></ul></nav>{main}<footer>{words(4)}</footer></body></html>', body
    made = [page(i) for i in range(150)]
    model = htmltext.Labeller().fit(*htmltext.training_set([h for h, _ in made]))
    found = [htmltext.blocks(h) for h, _ in made]
    got = [[b.text for b, ok in zip(p, m) if ok] for p, m in zip(found, model.content([htmltext.vectors(p) for p in found]))]
    assert [sum(g == b for g, (_, b) in zip(got[k::3], made[k::3])) for k in range(3)] == [50, 50, 50]
    assert not htmltext.silver(htmltext.blocks("<div class='content'><p>a</p></div>")).any()
    marked = htmltext.silver(htmltext.blocks("<div class='related'><article class='post notice'><p>a</p><div class='cookie-notice'>b</div><div class='ads'>c</div></article></div>"))
    assert marked.tolist() == [1, 0, 0]


def test_extraction_drops_boilerplate(llm, pages):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 500, n))

    def page(i):
        body = [words(12) for _ in range(4)]
        html = (f'<html><head><title>{words(3)}</title></head><body><nav><ul><li><a href="/">{words(1)}</a></li></ul></nav><div class="ad">{words(5)}</div>'
                f'<article><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p><p>{body[3]}</p></article><footer>{words(4)}</footer></body></html>')
        return i, html, "\n".join(body)
    made = [page(i) for i in range(120)]
    df = llm.createDataFrame([(i, None, h) for i, h, _ in made], "page_id long, url string, html string")
    model = htmltext.fit(df)
    got = {r["page_id"]: r for r in htmltext.extract(df, model).collect()}
    assert all(got[i]["text"] == t and got[i]["n_chars"] == len(t) for i, _, t in made)
    other = ('<body><header class="top"><p>Site name</p></header><aside class="sidebar"><p>see also</p></aside><div class="cookie-notice"><p>we use cookies</p></div>'
             f'<article><p>{words(30)}</p><form class="newsletter"><p>sign up</p></form><p>{words(25)}</p></article><section class="comments"><p>first!</p></section>')
    text = htmltext.extract(llm.createDataFrame([(1, "u", other)], "page_id long, url string, html string"), model).first()["text"]
    assert len(text.split("\n")) == 2 and "cookies" not in text
    forms = [words(20), words(3), words(15), words(8), words(9), words(25), words(30)]
    rich = ("<body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>{}</h1><h2>{}</h2><p>{}</p><ul><li>{}</li><li>{}</li></ul>"
            "<blockquote>{}</blockquote><p>{}</p></article><div class='comments'><div class='comment'><p>a reader's view</p></div></div><footer>end</footer>").format(*forms)
    text = htmltext.extract(llm.createDataFrame([(1, "u", rich)], "page_id long, url string, html string"), model).first()["text"]
    assert text == "\n".join(forms)
    odd = {r["page_id"]: r["text"] for r in htmltext.extract(pages, model).collect()}
    assert odd[1] == odd[2] == "" and len(odd) == len(ODD)
    assert htmltext.extract(pages.limit(0), htmltext.fit(pages.limit(0))).count() == 0
