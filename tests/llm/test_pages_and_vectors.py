"""Pages and embeddings: extraction, archives, near-duplicate vectors."""

import base64
import hashlib
import html
import re
import time
from collections import Counter

import numpy as np
import pytest

from demandlab.llm import host_paths, rabitq, warc
from demandlab.llm.common import Stages

PAGE = """<!doctype html><html><head><title>T &amp; x</title><script>if(a<b){{"</p>"}}</script></head><body class="with-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><aside>side</aside><div class="sidebar">more</div><div class="post-{n} content">
<div class=article-header><h1>Title <b>bold</b>er {n}</h1></div>
<p>First para &mdash; with&nbsp;a <a href="x">link</a><br>line two.<p>Second<span class="ad">BUY</span> para &lt;tag&gt; &#x41;
<ul><li>one<li>two</ul><div class="ad-box">buy buy buy</div><blockquote>quoted text</blockquote><form><input value=x>sub</form>
<!-- x --><p hidden>hid</p><section class="comments"><p>reader comment {n} long long long long long long long</p></section></div>
<div class="other">Read on elsewhere about {n}</div></div><footer>foot</footer></body></html>"""
TEXT = ("Title bolder {n}\n\nFirst para — with a link line two.\n\nSecond para <tag> A\n\none\n\ntwo\n\nquoted text")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://Site.example:80/p{i}", PAGE.format(n=i)) for i in range(20)]
    rows += [(30, "https://site.example/", "<div id=wrap><p>plain page without the usual path"), (31, None, PAGE.format(n=31)),
             (32, "https://site.example/x", None), (33, "odd", ""), (34, "https://b.example/", "just text &amp; more <3 <b"),
             (None, None, "<p>no id</p>"), (1, "https://site.example/p1", PAGE.format(n=1)), (40, "https://b.example/q", PAGE.format(n=1)),
             (41, "https://long.example/", "<article>" + "<p>word &copy; " * 20000 + "</article>"), (42, "https://f.example", "<form><p>all in a form")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_chars long").repartition(3)


def test_extract_pages(pages):
    got = host_paths.extract_pages(pages).collect()
    assert len(got) == 30 and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in [*range(20), 31]:
        assert text[i] == TEXT.format(n=i)
    assert text[40] == TEXT.format(n=1) and text[30] == "plain page without the usual path"
    assert text[32] == "" == text[33] and text[None] == "no id" and text[42] == "all in a form"
    assert text[34] == "just text & more <3" and text[41] == "\n\n".join(["word ©"] * 20000)


def test_host_path_wins_over_page(spark):
    """A page whose side text outweighs its article follows its host."""
    page = "<body><div class=a><p>{}</p></div><div class=b><p>{}</p></div></body>"
    rows = [(i, "http://h.example/", page.format(f"article {i} " * 30, "side " * 5)) for i in range(9)]
    rows.append((9, "http://h.example/", page.format("short article text here", "side " * 12)))
    got = {r.page_id: r.text for r in host_paths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short article text here"


def test_divided_articles_are_whole(spark):
    """Sections of an article, a title in its own container, and a page of another layout lose nothing."""
    lead, rest = "lead words here " * 8, "body words there " * 12
    parts = {"http://a.example/": "<article><section class=intro><p>{0}</p></section><section class=body><p>{1}</p></section></article>",
             "http://t.example/": "<div class=post><div class=title><h1>Title</h1><p>{0}</p></div><div class=body><p>{1}</p></div></div>",
             "http://n.example/": "<div class=x><div class=title><h2>Title</h2></div><div class=body><p>{0}</p><h2>Part</h2><p>{1}</p></div></div>",
             "http://s.example/": "<div class=x><div class=one><p>{0}</p></div><div class=two><p>{1}</p></div></div>"}
    rows = [(i, url, f"<body>{page}</body>".format(lead, rest)) for url, page in parts.items() for i in range(3)]
    plain = "<body><div class=a><p>{}</p></div></body>"
    rows += [(i, "http://o.example/", plain.format(f"text {i} " * 40)) for i in range(9)]
    rows.append((9, "http://o.example/", f"<body><div class=a><p>{lead}</p></div><div class=new><p>{rest}</p></div></body>"))
    got = {(r.page_id, r.url): r.text for r in host_paths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lead, rest = lead.strip(), rest.strip()
    want = dict(zip(parts, ([lead, rest], ["Title", lead, rest], ["Title", lead, "Part", rest], [lead, rest])))
    for (i, url), text in got.items():
        if url in want:
            assert text == "\n\n".join(want[url])
    assert got[9, "http://o.example/"] == f"{lead}\n\n{rest}" and got[0, "http://o.example/"] == ("text 0 " * 40).strip()


def plain(page):
    return host_paths.main_text(page, None)


def test_nothing_is_lost_in_deep_pages():
    """Short leads on every level, tags that nobody closes, ten thousand open elements."""
    leads = "".join(f"<div><p>lead {i}</p>" for i in range(12))
    assert plain(f"<body>{leads}<p>{'body words ' * 400}").startswith("\n\n".join(f"lead {i}" for i in range(12)) + "\n\nbody")
    for n in (1000, 10000):
        start = time.perf_counter()
        assert plain("<div>text" * n) == "\n\n".join(["text"] * n)
        assert plain("<div class=a><span class=b><li>" * n + "end") == "end"
        assert time.perf_counter() - start < 5
    boxes = "".join(f"<div class=w{'x' * i}>" + (f"<div class=n>{'lead ' * 4}</div>" if i else "") for i in range(12))
    kept = plain(f"<body>{boxes}<p>{'word ' * 400}")
    assert len(kept) >= 0.9 * (11 * 19 + 1999)  # not a tenth a level


@pytest.mark.parametrize("name", "elementor-widget widget-content menu-article login-guide share-price notice-period "
                                 "social-history story-comment sidebar widget header-ad".split())
def test_named_like_a_side_but_the_only_text(name):
    page = f"<body><nav>menu</nav><div class='{name}'><h1>T</h1><p>words</p><div class=comments><p>said by a reader here</div></div>"
    assert plain(page) == "T\n\nwords"


def test_parts_of_an_article_stay():
    assert plain("<article><h1>T</h1><section class=related-work><p>earlier</section><p>a <math><mi>x</mi><mo>=</mo></math> "
                 "<label>c</label> <object>d</object><blockquote>q<footer>who</footer></blockquote><fieldset><p>e</fieldset>"
                 "<dialog>f</dialog><div class=related><p>more</div><div class=related-reads><a href=x>one of many</a></div>"
                 "<section class=comments><p>reader</section></article><dialog>g</dialog>") \
        == "T\n\nearlier\n\na x= c d\n\nq\n\nwho\n\ne\n\nf"


def test_suspicion():
    assert {host_paths.suspicion(x) for x in "ad ad-box sidebar site-header cookie-notice comment-12 storyComments leftSidebar".split()} == {2}
    assert {host_paths.suspicion(x) for x in "related-work menu-article notice-period cookie-recipe".split()} == {1}
    assert {host_paths.suspicion(x) for x in "article-header no-sidebar with-ads content 12 adder".split()} == {0}


def test_recurring_suspects_and_plain_vote(spark):
    """A suspect container goes where its text recurs on the host's different pages; copies of one page don't count."""
    page = "<body><div class=top>{2}</div><article><h1>T {0}</h1><div class=notice-period><p>{1}</p></div><p>{3}</p></article></body>"
    rows = [(i, "http://same.example/", page.format(i, "we close at noon", "top", f"text {i} " * 9)) for i in range(6)]
    rows += [(i, "http://own.example/", page.format(i, f"terms {i} apply", "top", f"text {i} " * 9)) for i in range(6)]
    rows += [(i, "http://copies.example/", page.format(1, "once said", "top", "text " * 9)) for i in range(6)]
    rows += [(9, "http://own.example/", None), (10, "http://own.example/", "<p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in host_paths.extract_pages(frame).collect():
        if r.n_chars:
            assert ("close" not in r.text) and (("terms" in r.text) == ("own" in r.url)) and (("once" in r.text) == ("copies" in r.url))
    stages = Stages(spark)
    got = {r.host: (r.path, set(r.sides or ()), set(r.recurring or ())) for r in host_paths.host_paths(frame, stages).collect()}
    stages.close()
    for host in ("same.example", "own.example", "copies.example"):
        voted = [host_paths.page_votes(h or "") for _, u, h in rows if host in u]
        paths = Counter((v[1], v[5]) for vs in voted for v in vs if v[0] == host_paths.PATH)
        top = max({p for p, _ in paths}, key=lambda p: (sum(n for (q, _), n in paths.items() if q == p),
                                                        sum(n * w for (q, w), n in paths.items() if q == p), p))
        voters = sum(n for (q, _), n in paths.items() if q == top)
        beside = Counter(v[2] for vs in voted for v in vs if v[0] == host_paths.SIDE and v[1] == top)
        different = len({v[4] for vs in voted for v in vs})
        said = Counter((v[2], v[3]) for v in {v for vs in voted for v in vs if v[0] == host_paths.SUSPECT})
        assert got[host] == (top, {k for k, n in beside.items() if 2 * n >= voters},
                             {k for (k, _), n in said.items() if n >= 2 and 2 * n >= different})
    assert len(got["same.example"][2]) == 1 and not got["own.example"][2] and not got["copies.example"][2]


def test_extraction_of_given_pages(spark):
    """Every given page against a pattern written for its one template."""
    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in host_paths.extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        body = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_warc_round_trip(pages, spark):
    rows = pages.select("page_id", "url", "html").collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            key = r.html or ""
            first[key] = min(first.get(key, r.page_id), r.page_id)
    index, folder = warc.write_archives(pages, date="2024-02-29T00:00:00Z")
    got = warc.read_records(index, folder).collect()
    want = Counter()
    for r in rows:
        payload = (r.html or "").encode()
        again = r.page_id is not None and first[r.html or ""] != r.page_id
        want[(r.page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response",
              first[r.html or ""] if again else None, r.url, b"" if again else payload)] += 1
    assert Counter((*tuple(r)[:6], bytes(r.payload)) for r in got) == want
    none = warc.read_records(*warc.write_archives(pages, min_revisit=10 ** 9)).collect()
    assert {r.record_type for r in none} == {"response"}
    assert warc.read_records(*warc.write_archives(pages.limit(0))).count() == 0
    assert host_paths.extract_pages(pages.limit(0)).count() == 0


def test_look_up_opens_no_other_archive(pages, tmp_path):
    """A record is found by its identifier when all archives but its own are gone."""
    index, folder = warc.write_archives(pages, str(tmp_path / "archives"), date="2024-02-29T00:00:00Z")
    index = warc.sorted_index(index)
    rows = index.collect()
    assert {r.archive for r in rows} == {p.name for p in tmp_path.joinpath("archives").iterdir() if p.name[0] != "."}
    at = next(r for r in rows if r.page_id == 41)
    for p in tmp_path.joinpath("archives").iterdir():
        if p.name != at.archive:
            p.write_bytes(b"")
    got = warc.look_up(index, folder, [41, -1]).collect()
    assert [(r.page_id, r.record_type, r.url) for r in got] == [(41, "response", "https://long.example/")]
    assert hashlib.sha1(got[0].payload).digest() == base64.b32decode(got[0].payload_digest)
    assert warc.look_up(index, folder, [-1]).count() == 0


def test_frames_are_independent(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    writer, date = warc.ArchiveWriter(), "2024-02-29T00:00:00Z"
    records = [warc.warc_record(i, f"http://x/{i}", bytes([i]) * 50, warc.payload_digest(bytes([i]) * 50), None, date) for i in range(20)]
    index = [writer.add(r) for r in records]
    data = writer.finish()
    reader = warc.ArchiveReader(data)
    assert len(reader.plain) > 5
    for i in (19, 0, 7, 3):
        fields, payload = warc.parse_record(reader.record(*index[i]))
        assert payload == bytes([i]) * 50 and fields["warc-record-id"] == f"<urn:page:{i}>"
        assert fields["warc-date"] == date and fields["content-type"].startswith("text/html")
    import zstandard
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 16)  # large buckets meet as pairs of blocks
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 24))
    vecs = [base[i] for i in range(120)]
    for i in range(60):  # cosines from about 0.8 to 1
        vecs.append(base[i] + rng.standard_normal(24) * np.linalg.norm(base[i]) / np.sqrt(24) * rng.uniform(0, 0.75))
    vecs += [base[0] * 7 + rng.standard_normal(24) * 1e-3 for _ in range(70)] + [base[1]] * 9
    rows = [(k * 2, [float(x) for x in v], 1) for k, v in enumerate(vecs)]
    odd = [(901, None), (902, [0.0] * 24), (903, [1.0] * 23), (904, [float("nan")] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23),
           (906, [None] + [1.0] * 23), (907, []), (None, [float(x) for x in base[2]])]
    table = spark.createDataFrame(rows + [(i, v, 2) for i, v in odd], "vec_id long, embedding array<double>, component_id int").repartition(3)
    got = {r.vec_id: r for r in rabitq.near_duplicates(table).collect()}
    u = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    for k in range(len(u)):
        r = got[2 * k]
        assert (r.n_links, r.component_id, r.kept) == (near[k].sum() - 1, 2 * find(k), find(k) == k)
    for i, _ in odd:
        r = got[i]
        assert r.n_links == 0 and r.component_id == i and r.kept == (None if i is None else True)
    assert len(got) == len(rows) + len(odd)
    assert rabitq.near_duplicates(table.limit(0)).count() == 0


def test_code_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    unit = rng.standard_normal((300, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[1::2] = unit[::2] * 0.93 + unit[1::2] * 0.37
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = rabitq.rotations(64)
    code, factor = rabitq.encode(unit, turn)
    guess = np.where(code, 1, -1) / 16 @ (unit @ turn / 2).T / factor[:, None]
    exact = unit @ unit.T
    off = ~np.eye(300, dtype=bool)
    assert abs((guess - exact)[off].mean()) < 0.002
    error = np.sqrt((1 - factor ** 2) / factor ** 2 / 255)[:, None]
    assert (np.abs(guess - exact) <= rabitq.CONFIDENCE * error)[off].mean() > 0.9999
    i, j, tested = rabitq.near_pairs(unit, turn, 0.9)
    want = np.argwhere(np.triu(exact >= 0.9, 1))
    assert sorted(zip(i, j)) == sorted(map(tuple, want)) and tested < 0.1 * 300 * 299 / 2


def test_recall_of_tables():
    """Pairs exactly at the threshold meet in some table."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    b = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    turn, chosen = rabitq.rotations(64), rabitq.tables(10 ** 6, 64, 0.9)
    x, y = (rabitq.bucket_ids(rabitq.encode(v, turn)[0], chosen) for v in (a, b))
    assert (x == y).any(1).mean() > 0.95
