"""URL filter, HTML extraction and neighbour search, and the registered pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import html, neighbours, urls
from veinstone.llm.queries import URL_RULES


# ------------------------------------------------------------------------------------------- op 8
def judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    "http://a.com/x", "https://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/", "http://www.example.com/EN/", "ftp://x.net/es/",
    "http://net/fr/2", "http://notnet/fr/2", "http://x.com", "http://x.com?a=/b", "http://x.com#/b", "no scheme", "", None, "://", "a://b://c.com/d",
    "http://user@x.com:80/", "http://..com/", "http://com./", "http://ÉX.com/ä", "http://" + "a." * 5000 + "com/" + "p" * 50000,
    "http://x.com/\n/y", "//x.com/", "http://www.example.com/en/", "HTTP://WWW.EXAMPLE.COM/en/?q=http://z.net/es/"]


def test_url_verdicts_equal_brute_force(spark):
    rows = [(i if i % 7 else None, u, "<p>", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    want = Counter((i, *judge(u, URL_RULES)) for i, u, *_ in rows)
    assert Counter(map(tuple, urls.judge_urls(pages, rules).collect())) == want


def test_long_rule_lists_and_no_rules(spark):
    rules = [("block", f"h{i}.org", f"/{'p' * (i % 4)}") for i in range(3000)] + [("allow", "h5.org", "/p"), ("block", None, "/"), ("block", "h6.org", "")]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.org/pp/x") for i in range(0, 4000, 7)], "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    by_host = defaultdict(list)
    for r in rules:
        by_host[r[1]].append(r)
    want = Counter((r.page_id, *judge(r.url, by_host[f"h{r.page_id}.org"])) for r in pages.collect())
    assert Counter(map(tuple, urls.judge_urls(pages, table).collect())) == want
    assert {r.verdict for r in urls.judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), table).count() == 0


# ------------------------------------------------------------------------------------------- op 9
ARTICLE = "<h1>A &amp; B</h1><p><b>First  para\n of text, it has words.<br><p>Second &eacute; one. It ends.<ul><li>x<li>y</ul>"
TEXT = "A & B\nFirst para of text, it has words.\nSecond é one. It ends.\nx\ny"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def pages_of(spark, bodies):
    return spark.createDataFrame([(i, f"u{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(1)
    made = []
    for _ in range(60):
        prose = lambda n: " ".join(rng.choice(("alder", "brook", "cloud", "dawn", "elm,", "fern.")) for _ in range(n))
        made.append(page("<nav><ul>" + "".join(f"<li><a href=x>{prose(1)}</a></li>" for _ in range(6)) + f"</ul></nav><div class='ad'>{prose(9)}</div>"
                         f"<article><h1>{prose(6)}</h1>" + "".join(f"<p>{prose(rng.randint(1, 90))}</p>" for _ in range(rng.randint(1, 9)))
                         + f"</article><footer>&copy; {prose(8)}</footer>"))
    return html.train(made)


@pytest.mark.parametrize("dress", [
    "<nav><a href=x>Home</a></nav><article>{}</article><footer>&copy; us</footer>",
    "<div class='topmenu'><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><main>{}</main><aside>See this too, it is good.</aside>",
    "<header><p>Our site, the best.</p></header><article>{}<div class='comments'><p>I liked it. Thanks a lot!</p></div></article>",
    "<div class='cookie-notice'>We use cookies.</div><div id='content'>{}</div><form><label>Name</label><input name=n></form>",
    "<article>{}<form>Write to us <textarea>x</textarea></form><!-- <p>no</p> --></article><div class='sidebar'><p>Popular now</p></div>"])
def test_main_text_without_the_rest(model, dress):
    assert html.main_text(page(dress.format(ARTICLE)), model) == TEXT


def test_extraction_of_odd_pages(spark, model):
    bodies = [page(f"<article>{ARTICLE}</article>"), None, "", "plain words", "<", "<p", "<!-- open", "<script>alert(1)", "<article><p>" + "long " * 50000 + "</article>",
              "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "</p></div>", page(f"<article>{ARTICLE}</article>")]
    table = pages_of(spark, bodies).withColumns({c: F.lit(1) for c in ("key", "text", "n_chars")})
    out = {r.page_id: r for r in html.extract(table, model=model).collect()}
    assert len(out) == len(bodies) and out[0].text == out[11].text == TEXT
    assert [out[i].text for i in (1, 2, 4, 5, 6, 7, 10)] == [""] * 7
    assert out[8].n_chars == 50000 * 5 - 1 and all(r.n_chars == len(r.text) for r in out.values())
    assert html.extract(table.limit(0), model=model).count() == 0
    assert html.extract(pages_of(spark, ["<p>x</p>", None])).count() == 2  # nothing to learn from


def test_decoding_is_consistent(model):
    order = html.measure(html.parse(page(f"<div><article>{ARTICLE}</article><div><p>a</p></div></div>")))
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html.decode(order, rng.normal(size=len(order)) * 3)
        assert len(kept) == len(order)


# ------------------------------------------------------------------------------------------- op 4
def brute_neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v
          and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            found = sorted((-(v @ x) / np.sqrt((v @ v) * (x @ x)), i) for i, x in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(900)]
    rows += [(2000 + i, list(rows[7][1])) for i in range(200)]  # many equal vectors: ties go to the smaller id
    rows += [(1500, None), (1501, [0.0] * 16), (1502, [float("nan")] * 16), (1503, [float("inf")] + [1.0] * 15), (1504, [1.0] * 3), (None, rows[0][1]),
             (1550, [1.0] * 15 + [None])]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rank int, score int").repartition(3)
    want = brute_neighbours(rows, 5, 50)
    got = defaultdict(list)
    for r in neighbours.nearest(table, k=5, every=50, query_block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {q: dict(v) for q, v in brute_neighbours(rows, 10**6, 50).items()}
    for q, found in got.items():
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(exact[q][i], abs=1e-12) for i, s in found)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [0.0, 2.0], 0), (7, [-1.0, 0.0], 0)], schema)
    out = neighbours.nearest(few, k=5, every=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 50, 0.0), (0, 2, 7, -1.0), (50, 1, 0, 0.0), (50, 2, 7, 0.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, None, 0), (50, [0.0], 0)], schema)).count() == 0
    assert neighbours.nearest(few.filter("vec_id = 7")).count() == 0


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) > 0.5
    codes = neighbours.substrings(bits, 4)
    index = neighbours.MultiIndex(codes, [16] * 4)
    for radius in (0, 3, 17, 26, 29):
        masks = [neighbours.probes(16, r) if r >= 0 else np.zeros(0, np.uint16) for r in neighbours.shares(radius, 4)]
        for q in range(20):
            want = np.flatnonzero((bits != bits[q]).sum(1) <= radius)
            assert index.within(codes[q], radius, masks).tolist() == want.tolist()


# ------------------------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.schema == documents.schema, name
        if name != "mixing sources to target weights":
            assert docs.count() <= before.count()
    pieces = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


@pytest.mark.parametrize("page", ["<a x " * 200_000, '<a "' * 250_000, "<!" * 500_000, '<a "' * 250_000 + ">", '<a "\' ' * 160_000 + ">",
                                  "<p>x" * 250_000, "<title><select>" * 66_000, "<" * 1_000_000])
def test_a_megabyte_is_parsed_in_linear_time(page):
    import time

    start = time.process_time()
    html.parse(page)
    assert time.process_time() - start < 60  # a quadratic parser takes hours


def test_captions_of_controls_are_left_out():
    page = "<article><p>One <button class='x'>Share this</button> two.</p><label for=a>Your name</label><p>Three <button>open.</p></article>"
    top = html.parse(page)
    words, todo = [], [top]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, tuple):
                words.append(part[0])
            else:
                todo.append(part)
    assert "Share this" not in " ".join(words) and "Your name" not in " ".join(words)
    assert "open." in " ".join(words)  # not closed inside its parent: only the tag goes


def test_sample_is_chosen_by_hash(spark):
    from pyspark.sql import functions as F

    from veinstone.llm.common import first_by_hash

    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("v")).repartition(9)
    want = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(300).collect()
    assert first_by_hash(rows, 300, "id", "v") == want
    assert len(first_by_hash(rows, 9000, "id")) == 5000 and first_by_hash(rows.limit(0), 5, "id") == []
