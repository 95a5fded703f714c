import json
import uuid

from pyspark.sql import functions as F

from veinstone.functions import hashing, questions as qs, text as tx
from veinstone.functions.cutting import token_estimate


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s"))).first()[0]


def test_mixed_tokens(spark):
    tokens = one(spark, "翠湖授信 Greenlake Credit CTL-4616 审批门槛",
                 lambda s: tx.lexical_tokens(tx.normalize_search_text(s)))
    assert tokens[:3] == ["greenlake", "credit", "ctl-4616"]
    assert {"翠湖授信", "翠湖", "授信", "门槛"} <= set(tokens)


def test_single_cjk_character_and_long_span(spark):
    tokens = one(spark, "甲 " + "乙" * 25, lambda s: tx.lexical_tokens(s))
    assert tokens == ["甲", "乙乙"]


def test_casefold_and_nfkc(spark):
    assert one(spark, "Straße  Ａ\tＢ", tx.normalize_search_text) == "strasse a b"
    assert one(spark, " Ａ  b", tx.normalize_query) == "A b"


def test_exact_terms(spark):
    text = "翠湖授信由 ctl-4616 管控，运行时是 core-6216。"
    assert one(spark, text, tx.exact_terms) == ["core-6216", "ctl-4616"]


def test_identifier_boundaries(spark):
    assert one(spark, "xTX-0929-READY A-12 BIZ-1201中", tx.identifiers) == ["xTX-0929-READY", "BIZ-1201"]
    assert one(spark, "BKR0831 BKR0831x", tx.acronyms) == ["BKR0831"]


def test_thousands_separators(spark):
    def contains(answer, fact):
        return spark.createDataFrame([(answer, fact)], "a string, f string").select(
            tx.answer_contains(F.col("a"), F.col("f"))).first()[0]

    assert contains("limit CNY 527,400", "527400")
    assert not contains("limit CNY 527,401", "527400")


def test_rejoined_identifier(spark):
    assert one(spark, "TX-0929-R\nEADY\nnext line", tx.rejoin_wrapped_identifier) == "TX-0929-READY\nnext line"


def test_token_estimate_agrees(spark):
    for text in ["", "abc def", "订单取消必须由主管审批。", "a, b; c! 12.5 " * 9]:
        assert one(spark, text, tx.estimate_tokens) == token_estimate(text)


def test_safe_filename(spark):
    assert one(spark, "a/b/r*s?.txt", tx.safe_filename) == "r_s_.txt"
    assert one(spark, "a/", lambda s: tx.safe_filename(F.lit(""))) == "document"


def test_ids(spark):
    space = uuid.UUID("73ac24df-296f-4532-9dc8-e5890e877564")
    got = one(spark, "v", lambda s: hashing.chunk_id(s, F.lit(3), F.lit("h")))
    assert got == str(uuid.uuid5(space, "v:3:h"))


def test_record_hash_is_canonical_json(spark):
    import hashlib
    content = 'q"uote \\ tab\t 中文'
    got = one(spark, content, lambda s: hashing.record_hash(
        s, F.lit("h"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    want = json.dumps({"content": content, "heading_path": "h", "page_number": None, "sheet_name": None,
                       "cell_range": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()


SIGNALS = {
    "蓝湾托管系统的退款上限是多少？": ["蓝湾托管"],
    "For Harbour Lantern, who signs off?": ["Harbour Lantern"],
    "代码 QTZ2210 代表什么？": ["QTZ2210"],
    "For that, who signs off?": [],
    "青石登记处 当前由谁维护？": ["青石登记处"],
    "For Quiet Meadow（青石登记），比较期限": ["Quiet Meadow"],
    "Please tell us about Amber Pier": ["Amber Pier"],
    "Documents related to Amber Pier.": ["Amber Pier"],
    "Show details relevant to Amber Pier.": ["Amber Pier"],
}
PHRASINGS = [
    "请问有关琥珀码头的资料有哪些？", "关于“琥珀码头”，请说明要点。", "可否说明一下琥珀码头吗？",
    "琥珀码头的信息在哪里？", "琥珀码头的最新规则是什么？", "劳驾帮我查询一下琥珀码头", "琥珀码头，请总结一下。",
]


def test_question_signals():
    for question, wanted in SIGNALS.items():
        assert qs.signals(question) == wanted, question
    for question in PHRASINGS:
        assert qs.signals(question) == ["琥珀码头"], question


def test_plans():
    reply = {"language": "zh", "intent": "nonsense", "subjects": ["琥珀码头", "期限"],
             "requested_facts": ["期限"], "identifiers": ["MADE-77"], "retrieval_queries": ["琥珀码头 停泊"]}
    plan = qs.understand("琥珀码头 PRT-3310 的期限有多长？", json.dumps(reply, ensure_ascii=False))
    assert plan["strategy"] == "semantic-v2" and plan["intent"] == "unknown"
    assert plan["subjects"] == ["琥珀码头"] and plan["scenario_terms"] == ["期限"]
    assert plan["identifiers"] == ["PRT-3310"]
    assert plan["retrieval_queries"][1:] == ["琥珀码头 停泊"]
    fenced = "```json\n" + json.dumps(reply) + "\n```"
    assert qs.understand("琥珀码头 PRT-3310 的期限有多长？", fenced) == plan
    assert qs.understand("琥珀码头", "{}")["fallback_reason"] == "simple-query"
    assert qs.understand("For Amber Pier, what now?", "no json")["fallback_reason"] == "JSONDecodeError"
    assert qs.understand("For Amber Pier, what now?", "[1]")["fallback_reason"] == "ValueError"
    assert qs.anchors(["Amber Pier project"], ["X-12"]) == (
        ["Amber Pier project", "Amber Pier"], ["Amber Pier project", "Amber Pier", "X-12"])


def test_folding_of_question_words(spark):
    row = spark.createDataFrame([(["HauptStraße", "AB"],)], "s array<string>").select(qs.fold_all(F.col("s"))).first()
    assert row[0] == ["hauptstrasse", "ab"]


def test_readings_know_the_places_of_what_they_find(monkeypatch):
    import random

    from veinstone.functions import quotes

    calls = []
    monkeypatch.setattr(quotes.unicodedata, "category", lambda c, of=quotes.unicodedata.category: calls.append(c) or of(c))
    assert quotes.repair("ships | part | PRT-01", "ORD-1 ships part PRT-01 today") == "ships part PRT-01"
    assert not calls  # an ASCII text is read at once
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(" \t\n\x1caB1,2.-" + rng.choice(["", "éß中"])) for _ in range(rng.randrange(25)))
        for shown in (quotes._words, quotes._letters, quotes._plain, quotes._folded):
            pairs = [(c, (i, i + 1)) for i in range(len(text)) for c in shown(text, i)]
            pairs = pairs[1:] if pairs and pairs[0][0] == " " else pairs
            reading = quotes.Reading.of(text, shown)
            assert (reading.text, list(reading.places)) == ("".join(c for c, _ in pairs), [p for _, p in pairs])


def test_batches_are_read_in_pieces():
    import pyarrow as pa

    from veinstone.functions.batches import pieces

    texts = pa.array(["a" * 40, None, "b" * 900, "", *["c" * 30] * 20])
    flags = pa.array(range(len(texts)))
    cut = list(pieces(texts, flags, size=200))
    assert all(t.nbytes <= 200 or len(t) == 1 for t, _ in cut) and len(cut) > 5
    assert sum((t.to_pylist() for t, _ in cut), []) == texts.to_pylist()
    assert sum((f.to_pylist() for _, f in cut), []) == flags.to_pylist()
    assert [len(t) for t, in pieces(texts[:0])] == [0]
