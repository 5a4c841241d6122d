"""The operators on pages against brute force and exact round trips."""

import base64
import hashlib
import random
import time

from factloom.llm import html_template, urlfilter, warc
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, host string"


def test_warc_round_trip(spark):
    rng = random.Random(1)
    bodies = ["", "<p>é😀</p>\r\n\r\nWARC/1.1\r\n", "a" * 300_000, *["<b>%d</b>" % rng.random() for _ in range(5)]]
    rows = [(i, f"http://x.org/{i}\r\nEvil: 1" if i == 3 else None if i == 4 else f"http://x.org/{i}", rng.choice(bodies), "clash") for i in range(60)] + [(70, "u", None, "clash")]
    got = warc.read(warc.write(spark.createDataFrame(rows, PAGES).repartition(6))).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    by_id = {r.page_id: r for r in got}
    for i, _, h, _ in rows:
        r, raw = by_id[i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = last[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        if i == first:
            assert bytes(r.payload) == raw


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h, p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "badexample.org", "com", "x.com", "org", "é.org", "", "org.", "x..com", "example.org:80"]
    paths = ["", "/", "/es/", "/es", "/es/a/b", "/en/1", "/en/12?x", "/fr/x", "/de/", "/de/y#z", "?q=/es/", "#/es/", "/ES/", "//es/"]
    urls = [rng.choice(["http://", "https://", "x://y://"]) + h + p for h in hosts for p in paths] + [None, "", "example.org/es/", "http://", "http:///es/"]
    rows = [(i, u, None, "clash") for i, u in enumerate(urls)] + [(0, urls[0], None, "clash")]
    got = urlfilter.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id]), urls[r.page_id]


def test_main_text_of_a_host(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, want = [], {}
    for i in range(30):
        blocks = [" ".join(word() for _ in range(rng.randint(35, 60))) for _ in range(3)]
        tail = word()  # a paragraph equal on all pages would be template
        want[i] = " ".join(blocks) + f" R&D é {tail}"
        body = "".join(f"<p>{b.replace(' ', chr(10), 1)}</p>" for b in blocks) + f"<p> R&amp;D &eacute; {tail}</p>"
        rows.append((i, f"http://news.org/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><header>News of the day</header><article>{body}</article><aside>More to read</aside><footer>All rights reserved</footer><script>x('<p>')</script></body></html>", "clash"))
    rows += [(90, None, None, "c"), (91, "http://news.org/x", "", "c"), (92, "http://one.net/", "<p>Only this text", "c"), (93, "http://news.org/y", "<", "c")]
    got = {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert {i: got[i].text for i in want} == want
    assert got[90].text == got[91].text == "" and got[92].text == "Only this text"


def test_names_decide_only_where_no_article_stands():
    main = html_template.main_text
    assert main('<div class="layout has-sidebar"><article><h1>T</h1><p>Hello body</p></article></div>') == "T Hello body"
    assert main('<article><div class="entry-header"><h1>Head</h1></div><p class="legal">Terms</p><p><label>By</label> me</p></article>') == "Head Terms By me"
    assert main('<div class="sidebar-layout"><p>' + "word " * 50 + '</p></div><div class="sidebar">Side</div>') == ("word " * 50).strip()
    assert main("<ul><li><a href=a>A</a></li><li><a>B</a></li></ul><p>Text <a>link</a></p><p><a>alone</a></p>") == "Text link alone"
    assert main('<article><p>a</p><div class="ad">x</div><div id="comments"><p>c</p></div><form>f</form><footer>g</footer></article>') == "a"
    assert main("<header><h1>Site</h1></header><main><header><h1>Title</h1></header>x &amp; y</main>") == "Title x & y"


def test_pages_of_any_length_take_time_in_proportion():
    for tag in ("<b>", "<p><div>", "<li><span>", "</x><i>"):
        began = time.time()
        assert html_template.main_text(tag * 100_000 + "end") == "end"
        assert time.time() - began < 4


def brute_template(pages):
    """Tokens of classes of two or more with equal counts on the same pages, on three fifths of them or more, that nest."""
    counts = []
    for page in pages:
        seen = {}
        for k, h in enumerate(html_template.Page(page).hashes()):
            if h is not None:
                seen.setdefault(h, []).append(k)
        counts.append(seen)
    classes = {}
    for token in set().union(*counts):
        vector = tuple(len(c.get(token, ())) for c in counts)
        on = [c[token][0] for c in counts if token in c]
        if len(on) >= max(0.6 * len(pages), 1.8):
            classes.setdefault(vector, []).append((sum(on) / len(on), token))
    valid, out = [], set()
    for found in sorted((x for x in classes.values() if len(x) > 1), key=lambda x: (-len(x), min(x))):
        places = [p for p, _ in found]
        between = lambda inner, outer: len({sum(x <= y for x in outer) for y in (min(inner), max(inner))}) == 1
        if all(between(places, v) or between(v, places) for v in valid):
            valid.append(places)
            out |= {t for _, t in found}
    return out


def test_templates_match_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    notice, bar = text(60), text(4)  # a long text that stands on most pages is template, too
    pages = []
    for i in range(30):
        bits = [f"<p>{text(rng.randint(5, 40))}</p>" for _ in range(rng.randint(1, 4))]
        extra = f"<div><p>{bar}</p><span>{bar}</span></div>" if i % 4 else ""
        pages.append(f"<div><b>{bar}</b></div>{extra}<section>{''.join(bits)}</section><div><p>{notice}</p></div>")
    rows = [(i, f"http://one.org/{i}", p, "c") for i, p in enumerate(pages)] + [(100 + i, f"http://one.org/copy{i}", pages[0], "c") for i in range(60)]
    rows += [(200 + i, f"http://few.org/{i}", f"<p>{text(9)}</p><p>{bar}</p>", "c") for i in range(2)] + [(300 + i, f"http://same.org/{i}", pages[1], "c") for i in range(20)]
    docs = spark.createDataFrame(rows, PAGES).repartition(4)
    known = docs.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.xxhash64("html").alias("h"), "html")
    got = {r.host: html_template.nested([(t["c"], t["at"], t["token"]) for t in r.template]) for r in html_template.templates(known).collect()}
    assert set(got) == {"one.org"} and got["one.org"] == brute_template(pages)  # copies count once; two pages or one make no template
    texts = {r.page_id: r.text for r in html_template.extract(docs).collect()}
    assert all(texts[i] and notice not in texts[i] and (i % 4 or bar not in texts[i]) for i in range(30)) and texts[300].startswith(bar) and bar in texts[200]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    for out in (html_template.extract(pages), warc.read(warc.write(pages)), urlfilter.judge(pages)):
        assert out.collect() == []
