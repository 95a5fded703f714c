"""Cases where an operator did less than its whole job."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from test_pages_and_vectors import model, page  # noqa: F401
from veinstone.functions.batches import PIECE
from veinstone.llm import html, jaccard, packing, quality, secrets


# ------------------------------------------------------------------------------------------- op 2
@pytest.mark.parametrize("text, secret", [
    ('password: str = "hunter2-Xk9q"', "hunter2-Xk9q"), ('let token: String = "Zx81-qPw9-77";', "Zx81-qPw9-77"),
    ('password: str = "hunter2-Xk9q"\ntoken: str = "Zx81-qPw9-77"', "Zx81-qPw9-77"),
    ('auth_token: Optional[str] = "Zx81-qPw9-77"', "Zx81-qPw9-77"), ('secret = (\n    "Zx81-qPw9-77")', "Zx81-qPw9-77"),
    ('{"password":\n  "Zx81 qPw9-77"}', "Zx81 qPw9-77"), ('token = getenv("X", "Zx81-qPw9-77")', "Zx81-qPw9-77"),
    ('token = os.getenv("X", default="Zx81-qPw9-77")', "Zx81-qPw9-77"), ('secret = f("x") or "Zx81-qPw9-77"', "Zx81-qPw9-77"),
    ('secret = \\\n  "Zx81-qPw9-77"', "Zx81-qPw9-77"), ('k = (\n "Zx81-"\n "qPw9-77"\n)\nauth_token = k', "qPw9-77"),
    ('token = ["a", "Zx81-qPw9-77"]', "Zx81-qPw9-77"), ('a = "Zx8-"\\\n  + "qPw9"\npassword = a', "qPw9"),
    ('passphrase = "correct horse battery staple"', "correct horse battery staple"),
    ('k = "' + "Zx81-qPw9" * 600 + '"\nprivate_key = k', "Zx81-qPw9" * 600), (':-( x\nf(\ndb_pwd = "Zx81-qPw9-77"', "Zx81-qPw9-77")])
def test_assignments_of_ordinary_syntax_are_found(text, secret):
    at = text.index(secret)
    assert (at, at + len(secret)) in {(s, e) for s, e, _ in secrets.scan(text)}
    assert secret not in secrets.redact(text, secrets.scan(text))


@pytest.mark.parametrize("text", [
    "token = load(\nauthor = 'Jane-Roe 81x'\nother 'Zx81-qPw9-77'", "token: str\nname: str = 'Zx81-qPw9-77'", "token = f(x)\nsay 'Zx81-qPw9-77'",
    "password:\n\nThe first one of them", 'token = names["Zx81-qPw9-77"]', 'cfg = {"token": load(), "title": "Zx81-qPw9-77"}'])
def test_other_literals_are_not_credited(text):
    assert [s for s in secrets.scan(text) if s[2] == "literal"] == []


def test_long_chains_of_constants_take_linear_work():
    text = 's = "Zx81"\n' + 's = s + "qP9-x"\npassword = s\n' * 20_000
    assert len(secrets.scan(text)) == 20_001


# ------------------------------------------------------------------------------------------- op 9
FAR = "<p>Dawn alder, brook fern. Cloud elm, the dawn.</p>"


@pytest.mark.parametrize("inside, want", [
    ('<div class="md:flex hidden lg:block"><p>Alder brook, cloud dawn elm. Fern alder.</p></div>', "Alder brook"),
    ('<section title="The hidden world"><p>Alder brook, cloud dawn elm. Fern alder.</p></section>', "Alder brook"),
    ('<div data-x="display:none"><p>Alder brook, cloud dawn elm. Fern alder.</p></div>', "Alder brook"),
    ("<p>Alder <math><mi>qx</mi></math> and <svg><text>qy</text></svg>, <object>qz</object> fern. <noscript>qn</noscript></p>", "Alder qx and qy, qz fern. qn"),
    ("<p>Alder brook.</p><canvas width=3>", "Alder brook"), ("<video src=x><p>Alder brook.</p>", "Alder brook"), ("<svg><p>Alder brook.</p>", "Alder brook"),
    ("<p>Alder <video>no film <div>here</div></video>brook.</p>", "Alder brook.")])
def test_articles_are_kept_whole(model, inside, want):
    text = html.main_text(page(f"<nav><a href=x>Home</a></nav><article>{FAR}{inside}{FAR}</article><footer>&copy; us</footer>"), model)
    assert want in text and text.count("Dawn alder") == 2 and "Home" not in text and "film" not in text


def test_hidden_parts_are_left_out_by_the_model(model):
    for how in ("hidden", "style='color:red; display:none'", "aria-hidden=true"):
        body = f"<article>{FAR * 3}<div {how}><p>Subscribe to it now, please. It costs nothing.</p></div></article>"
        assert html.main_text(page(body), model) == "\n".join(["Dawn alder, brook fern. Cloud elm, the dawn."] * 3)


def test_deep_trees_close_their_own_elements():
    top = html.parse("<div><article>" + "<div>" * 600 + "deep" + "</div>" * 600 + "<p>after</p></article></div><p>out</p>")
    assert [p if isinstance(p, tuple) else p.tag for p in top.children[0].children[0].parts] == ["div", "p"]
    assert [c.tag for c in top.children] == ["div", "p"]
    assert len(html.measure(html.parse("<figure>" * 50_000 + "</ul>" * 50_000))) == 50_001


# ------------------------------------------------------------------------------------------- op 6
def test_one_of_each_group_stays_without_and_with_repeated_ids(spark):
    long = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcd"]
    near = [text + " more" for text in long]
    rows = [(1, long[0], 0), (None, near[0], 1), (None, long[1], 2), (None, near[1], 3), (None, long[1], 4), (None, None, 5), (None, "", 6),
            (7, long[2], 7), (7, long[3], 8), (8, near[2], 9), (7, near[2], 10), (5, near[3], 11), (None, "", 12), (7, long[2], 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = {r.n for r in jaccard.keep_one(docs).collect()}
    group = [{0, 1}, {2, 3, 4}, {5}, {6, 12}, {7, 10, 13}, {11}]
    assert len(kept) == len(group) and all(len(kept & g) == 1 for g in group) and 0 in kept


def test_repeated_values_are_counted():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (3, 1), (4, 1), (60, 5), (5000, 1), (5000, 900)):
        values = rng.integers(0, kinds, n).astype(np.uint64)
        want = sorted((v, c) for v, c in Counter(values.tolist()).items() if c >= 4)
        assert list(zip(*(x.tolist() for x in jaccard._repeated(values)), strict=True)) == want


# ------------------------------------------------------------------------------------------- pipeline
class Task:
    """Stands for a table: its ``mapInArrow`` gives the function that a task runs."""

    columns, schema = ["doc_id", "text", "lang", "source", "n_chars"], None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def judge(monkeypatch):
    class Flat:
        def log_odds(self, x):
            return np.ones(len(x))

    monkeypatch.setattr(quality, "fit", lambda *_, **__: (Flat(), Flat(), 0.0, 0.0))
    monkeypatch.setattr(quality, "views", lambda documents: documents)

    class Kept:
        def keep(self, documents):
            return documents

    return quality.keep_good(Task(), None, Kept())


@pytest.mark.parametrize("name, held", [("views", PIECE), ("judge", PIECE), ("scan", PIECE), ("redact", PIECE), ("cut", PIECE),
                                        ("shingles", jaccard.SLICE), ("keys", jaccard.SLICE)])
def test_a_task_holds_a_piece_of_a_batch(spark, monkeypatch, name, held):
    monkeypatch.setattr(jaccard, "FLUSH", 1 << 16)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=600)) + " password = hunter2hunter" for _ in range(1200 if held == PIECE else 4000)]
    ids = pa.array(range(len(texts)), pa.int64())
    columns = {"doc_id": ids, "text": pa.array(texts), "lang": pa.array(["en"] * len(ids)), "source": pa.array(["s"] * len(ids)), "n_chars": ids}
    if name in ("views", "cut"):
        columns = {c: columns[c] for c in (("doc_id", "text", "lang", "source") if name == "views" else ("doc_id", "text"))}
    if name == "shingles":
        columns = {"doc_id": ids, "text": columns["text"], "digest": columns["lang"]}
    one = pa.RecordBatch.from_pydict(columns)
    often = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    run = {"views": lambda: quality.views(Task()), "judge": lambda: judge(monkeypatch), "shingles": lambda: jaccard._scan,
           "keys": lambda: jaccard._keys(4, often), "scan": lambda: secrets.scan_documents(Task()),
           "redact": lambda: secrets.redact_documents(Task()), "cut": lambda: packing.cut_pieces(Task(), 2048, "byte_bpe_50k.json")}[name]()
    for _ in run(iter([one.slice(0, 2)])):  # what a worker loads once
        pass
    del texts, columns
    rows = 0
    tracemalloc.start()
    try:
        for out in run(iter([one])):
            rows += out.num_rows
            assert out.num_rows < one.num_rows / 10 or held > PIECE
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= one.num_rows and peak < (0.5 if held == PIECE else 1.5) * one.nbytes


# ------------------------------------------------------------------------------------------- op 10
def test_sure_documents_are_exchanged_once_each(spark):
    rows = [(i, [1.0, 0.0], [0.0, 0.0, 1.0], 9.0, 0.0) for i in range(500)] + [(i, [i / 9, 1.0], [0.0, 1.0, 1.0], 5.0 - i % 2 * 10, 5.0) for i in range(500, 530)]
    scored = spark.createDataFrame(rows, "doc_id long, text_view array<float>, meta_view array<float>, s_text_view double, s_meta_view double")
    cells = quality.examples(scored, "text_view", "meta_view", 3.0, []).collect()
    assert sorted((r.meta_view, r.label, r.copies) for r in cells) == [([0, 0, 1], 1, 500), ([0, 1, 1], 0, 15), ([0, 1, 1], 1, 15)]
    first = quality.examples(scored, "meta_view", "text_view", 3.0, []).limit(20).collect()
    rest = quality.examples(scored, "meta_view", "text_view", 3.0, [(r.name,) for r in first]).collect()
    assert len(rest) == 10 and len({tuple(r.text_view) for r in first + rest}) == 30


def test_metadata_values_count_whole():
    names = ["s" * 70 + str(i) for i in range(40)]
    assert len({tuple(quality.meta_features("en", n, 5)) for n in names}) > 32
