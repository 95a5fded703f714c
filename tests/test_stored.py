"""Stored indexes, generations, routing, the worker stream and file lookup against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veinstone import cluster
from veinstone.cluster import cut_lineage
from veinstone.config import EngineConfig
from veinstone.operators import catalog, lexical, postings, sync, usage, vector, vector_index
from veinstone.operators.scope import is_searchable
from veinstone.plans import kb, reindex, retrieve
from veinstone.registry import all_queries
from veinstone.registry import catalog as registered
from veinstone.registry.catalog import record_rows
from veinstone.sources import vector_blocks
from veinstone.streaming import outbox, worker

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty kelp lagoon maple north ocean pine quay river".split()


# ------------------------------------------------------------------------------------ inverted index
@pytest.fixture(scope="module")
def projected(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "s", "-1", f" LOT-{rng.randrange(40):03d}"]) for _ in range(rng.randrange(1, 12)))
        rows.append((f"c{i:04d}", f"p{i % 3}", f"file{i % 7}.md", rng.choice([None, "Harbour log", "翠湖 notes"]), rng.choice([text, text, "", None, "翠湖授信 " + text])))
    frame = spark.createDataFrame(rows, "chunk_id string, project_id string, filename string, heading_path string, content string")
    return cut_lineage(lexical.search_projection(frame))


@pytest.fixture(scope="module")
def stored(projected, tmp_path_factory):
    return postings.write_index(projected, str(tmp_path_factory.mktemp("index") / "lists"), block=64)


def bounds_of(index, numbered):
    asked = postings._ask(index, numbered)
    return {r.block: r.bound for r in postings._bounds(index.lists.join(asked.users, "term"), asked).collect()}


def same_hits(left, right):
    def rows(frame):
        return {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in frame.collect()}

    assert rows(left) == rows(right)


@pytest.mark.parametrize("k", [1, 5, 50, 2000])
def test_stored_lists_answer_like_the_scan(spark, projected, stored, k):
    rng = random.Random(k)
    asked = [(i, " ".join(rng.choice([*WORDS, "LOT-007", "av", "ir", "翠湖", "zzz", "lago", "LOT-03"]) for _ in range(rng.randrange(1, 9))))
             for i in range(12)] + [(99, ""), (100, "nothing_like_it")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    same_hits(postings.postings_search(stored, queries, k), lexical.lexical_search(projected, queries, k))


def test_signals_are_met_by_equality(spark, tmp_path):
    """Codes that share their trigrams: no join grows with the pairs of a word and a signal."""
    codes = [f"k-{a}{b}{c}{d}" for a in "123" for b in "123" for c in "123" for d in "123"]
    rows = [(f"c{i:03d}", f"{code} stays", [], []) for i, code in enumerate(codes)]
    frame = spark.createDataFrame(rows, "chunk_id string, raw_text string, postings array<struct<token: string, weight: int>>, exact_terms array<string>")
    index = postings.write_index(frame, str(tmp_path / "codes"), block=32)
    wanted = [*codes, "k-12", "-3332", "2121", "absent", "k-9999", "stay", "k-12", "ta"]
    signals = spark.createDataFrame([(s,) for s in wanted], "signal string")
    found = postings.signal_words(index, signals.filter("length(signal) > 3"))
    words = [*codes, "stays"]
    assert Counter(map(tuple, found.collect())) == Counter((s, w) for s in set(wanted) if len(s) > 3 for w in words if s in w)
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_blocks_below_the_edge_are_left_out(spark, projected, tmp_path):
    """One block holds the best chunks; after it no other block can reach the k-th score."""
    rows = projected.filter("content is not null").limit(200).unionByName(
        projected.limit(1).withColumns({"chunk_id": F.lit("best"), "raw_text": F.lit("sole heron"), "postings": F.array(
            *[F.struct(F.lit(t).alias("token"), F.lit(9).alias("weight")) for t in ("sole", "heron")])}))
    index = postings.write_index(rows, str(tmp_path / "lists"), block=16)
    asked = cut_lineage(lexical.question_terms(spark.createDataFrame([(1, "sole heron maple")], "query_id int, text string")).withColumn(
        "_no", F.lit(0)))
    bounds = bounds_of(index, asked)
    home = index.chunks.filter("chunk_id = 'best'").first().block
    assert max(bounds, key=bounds.get) == home
    best = postings.postings_search(index, spark.createDataFrame([(1, "sole heron maple")], "query_id int, text string"), 1).first()
    assert best.chunk_id == "best"
    assert all(b < best.score - 1.0 for block, b in bounds.items() if block != home)


def test_bounds_hold(spark, stored):
    asked = cut_lineage(lexical.question_terms(spark.createDataFrame([(1, "cedar river LOT-007 ra lagoon")], "query_id int, text string")).withColumn(
        "_no", F.lit(0)))
    bounds = bounds_of(stored, asked)
    found = postings.postings_search(stored, spark.createDataFrame([(1, "cedar river LOT-007 ra lagoon")], "query_id int, text string"), 5000)
    for r in found.join(stored.chunks.select("chunk_id", "block"), "chunk_id").collect():
        assert r.score <= bounds[r.block] + 1.0 + 1e-9


def test_substrings_by_lists(spark, projected, stored):
    signals = ["ed", "lago", "lot-03", "ver", "翠湖授", "nosuchthing", "s", "agoon", "r"]
    signals = [s for s in signals if len(s) >= 2]
    got = Counter(map(tuple, postings.signal_chunks(stored, spark.createDataFrame([(s,) for s in signals], "signal string")).collect()))
    want = Counter((s, r.chunk_id) for r in projected.collect() for s in signals if s in r.raw_text)
    assert got == want


def test_chunks_and_lists_stay_where_they_lie(spark, projected, tmp_path):
    """Blocks are rows of one partition in a row; each block of a task has one list a term, and segments are in order."""
    rows = projected.repartition(3, "chunk_id")
    index = postings.write_index(rows, str(tmp_path / "lists"), block=50)
    lain = {r.chunk_id: r.p for r in rows.select("chunk_id", F.spark_partition_id().alias("p")).collect()}
    held = defaultdict(list)
    for r in index.chunks.collect():
        held[r.block].append((r.no, lain[r.chunk_id]))
    assert sum(map(len, held.values())) == 900
    assert all(sorted(no for no, _ in b) == list(range(len(b))) and len(b) <= 50 and len({p for _, p in b}) == 1 for b in held.values())
    lists = index.lists.select("term", "block").withColumn("file", F.input_file_name()).collect()
    assert len({(r.term, r.block) for r in lists}) == len(lists)
    by_file = defaultdict(list)
    for r in lists:
        by_file[r.file].append((r.term, r.block))
    assert all(rows == sorted(rows) for rows in by_file.values())


def test_blocks_that_reading_cuts_keep_their_rows(spark, projected, stored, tmp_path):
    """Lists of a block whose rows come in many batches, or in parts, add up to its chunks."""
    table = stored.chunks.select("block", "no", "raw_text", "postings", "exact_terms").filter("block = 0").orderBy("no").toArrow()
    whole = pa.concat_tables(map(postings._block_lists, postings._blocks(iter(table.to_batches(max_chunksize=7)))))
    assert whole.sort_by("term").equals(postings._block_lists(table).sort_by("term"))
    parts = [postings._block_lists(table.slice(at, 30)) for at in range(0, table.num_rows, 30)]
    docs = defaultdict(bytes)
    for part in parts:
        for term, of in zip(part.column("term").to_pylist(), part.column("docs").to_pylist(), strict=True):
            docs[term] += of
    assert docs == dict(zip(whole.column("term").to_pylist(), whole.column("docs").to_pylist(), strict=True))


def test_many_signals_are_met_where_the_lists_lie(spark, projected, stored, monkeypatch):
    """More signals than are looked up: same answers, and no list is shuffled to meet the words that hold a signal."""
    monkeypatch.setattr(postings, "FEW_TERMS", 2)
    queries = spark.createDataFrame([(i, f"{w} {w[1:]} lago LOT-0{i:02d} 翠湖授") for i, w in enumerate(WORDS)], "query_id int, text string")
    same_hits(postings.postings_search(stored, queries, 7), lexical.lexical_search(projected, queries, 7))
    terms = lexical.question_terms(queries).withColumn("_no", F.col("query_id"))
    asked = postings._ask(stored, cut_lineage(terms))
    assert asked.inside and asked.users.filter("term like 'w%'").isEmpty()
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" not in postings._of_users(stored, asked.users)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


# ------------------------------------------------------------------------------------ vector index
@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(f"v{i:05d}", (centres[i % 12] + 0.25 * rng.normal(size=16)).astype("float32").tolist()) for i in range(3000)]
    rows += [("null", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("inf", [float("inf")] * 16), ("hole", [None] * 16), ("empty", [])]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>")


def test_proven_search_is_the_full_scan_and_reads_less(spark, clustered, tmp_path):
    vector_index.write_vectors(clustered, str(tmp_path / "v"))
    index = vector_index.VectorIndex(spark, str(tmp_path / "v"))
    good = clustered.filter("chunk_id like 'v%'")
    asked = good.filter("chunk_id in ('v00007', 'v01234')").select(F.col("chunk_id").alias("query_id"), "embedding").withColumnRenamed("embedding", "vector")
    got, share = vector_index.index_search(index, asked, 20)
    same_hits(got, vector.vector_search(good, asked, 20))
    assert share < 0.5 and index.size.sum() == 3000
    near, read = vector_index.index_search(index, asked, 20, probes=8, proven=False)
    exact = {(r.query_id, r.chunk_id) for r in got.collect()}
    assert len(exact & {(r.query_id, r.chunk_id) for r in near.collect()}) >= 0.95 * len(exact) and read < 0.5
    same_hits(vector_index.index_search(index, asked, 5000, 0.9)[0], vector.vector_search(good, asked, 5000, 0.9))


def test_partitions_that_are_not_probed_are_not_read(spark, clustered, tmp_path):
    vector_index.write_vectors(clustered, str(tmp_path / "v"))
    index = vector_index.VectorIndex(spark, str(tmp_path / "v"))
    plan = index.rows.filter(F.col("cell").isin([0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]


# ------------------------------------------------------------------------------------ vector blocks
def test_blocks_come_back_and_damage_is_an_error(spark, tmp_path):
    vector_blocks.register(spark)
    rows = [(f"v{i}", [float(i), -0.5, 1e-30]) for i in range(100)]
    folder = str(tmp_path / "blocks")
    frame = spark.createDataFrame(rows, vector_blocks.SCHEMA).repartition(3)
    frame.write.format("vector_blocks").option("rows", 16).mode("append").save(folder)
    read = spark.read.format("vector_blocks").load(folder)
    assert Counter((r.chunk_id, tuple(r.embedding)) for r in read.collect()) == Counter(
        (r.chunk_id, tuple(r.embedding)) for r in frame.collect())
    frame.limit(10).write.format("vector_blocks").mode("overwrite").save(folder)
    read = spark.read.format("vector_blocks").load(folder)
    assert read.count() == 10
    path = next((tmp_path / "blocks").iterdir())
    data = path.read_bytes()
    for broken in (data[:-1], data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], b"nothing", data[:20]):
        path.write_bytes(broken)
        with pytest.raises(Exception, match="(checksum mismatch|bytes where|no vector block|unreadable header)"):
            read.collect()
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], vector_blocks.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="vectors of one length"):
        ragged.write.format("vector_blocks").mode("append").save(folder)


def test_no_blocks(spark, tmp_path):
    vector_blocks.register(spark)
    folder = str(tmp_path / "none")
    spark.createDataFrame([], vector_blocks.SCHEMA).write.format("vector_blocks").mode("append").save(folder)
    assert spark.read.format("vector_blocks").load(folder).count() == 0


# ------------------------------------------------------------------------------------ generations
def test_rebuild_resumes_and_switches_at_the_end(spark, tmp_path):
    rows = [(f"w{v}", f"w{v}:{i}", i, f"h{v}{i}") for v in range(20) for i in range(v % 4 + 1)]
    chunks = spark.createDataFrame(rows, "version_id string, chunk_id string, ordinal int, record_hash string")
    folder, calls = str(tmp_path / "g"), []

    def breaks(part):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("the machine is gone")
        return part

    reindex.reindex(chunks, folder, 1, project=lambda part: part)
    with pytest.raises(OSError, match="gone"):
        reindex.rebuild(chunks, folder, 2, project=breaks)
    with pytest.raises(RuntimeError, match="not complete"):
        reindex.switch(spark, folder, 2)
    assert reindex.current_generation(spark, folder) == 1
    assert reindex.rebuild(chunks, folder, 2, project=lambda part: part.filter("chunk_id <> 'w7:1'")) == [2, 3]
    reindex.switch(spark, folder, 2)
    assert reindex.current_generation(spark, folder) == 2
    broken = {r.version_id for r in reindex.verdicts(spark, folder, 2).filter("not verified").collect()}
    assert broken <= {"w7"}
    assert {r.version_id for r in reindex.served(spark, folder).collect()} == {f"w{v}" for v in range(20)} - broken


def test_lost_version_is_not_verified(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "a:0", 0, "x"), ("b", "b:0", 0, "y")], "version_id string, chunk_id string, ordinal int, record_hash string")
    judged = reindex.reindex(chunks, str(tmp_path / "g"), 5, project=lambda part: part.filter("version_id <> 'b'"))
    assert {r.version_id: r.verified for r in judged.collect()} == {"a": True, "b": False}


# ------------------------------------------------------------------------------------ routing
def test_requests_are_served_in_order(spark):
    rng = random.Random(8)
    models = [("a", "max", 1000, 1, True), ("b", "max", 0, 2, True), ("c", "max", 500, 3, False), ("d", "max", 700, 4, True), ("e", "plus", 300, 1, True)]
    spent = [("a", "success", 200), ("a", "failed", 900), ("d", "success", 90)]
    requests = [(i, rng.choice(["max", "plus"]), rng.randrange(1, 60)) for i in range(120)]
    want, used = set(), defaultdict(int, {"a": 200, "d": 90})
    for i, tier, tokens in requests:
        attempt = 1
        for m, t, quota, _, enabled in models:
            if t != tier or not enabled or used[m] >= int(quota * 0.9):
                continue
            if m == "a" and i % 5 == 0:
                want.add((i, tier, attempt, m, "failed", 0))
                attempt += 1
                continue
            used[m] += tokens
            want.add((i, tier, attempt, m, "success", tokens))
            break
        else:
            want.add((i, tier, attempt, None, "exhausted", 0))
    got = usage.allot_requests(
        spark.createDataFrame(requests, "request_id long, tier string, tokens long").repartition(4),
        spark.createDataFrame(models, "model_id string, tier string, quota_tokens bigint, priority int, enabled boolean"),
        spark.createDataFrame(spent, "model_id string, result_status string, total_tokens long"),
        (F.col("model_id") == "a") & (F.col("request_id") % 5 == 0))
    assert {tuple(r) for r in got.collect()} == want


# ------------------------------------------------------------------------------------ worker stream
def run_events(spark, tmp_path, files):
    schema = "event_id long, job_id long, kind string, at timestamp"
    start, out = datetime(2024, 1, 1), []
    for n, rows in enumerate(files):
        frame = spark.createDataFrame([(i, j, k, start + timedelta(seconds=s)) for i, j, k, s in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events" / f"{n}"))
    known = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", worker.STATE_STORE)
    try:
        for n in range(len(files)):  # one trigger a file
            events = outbox.read_events(spark, str(tmp_path / "events" / f"[0-{n}]"), schema)
            query = worker.worker_actions(events, "1 minute").writeStream.format("parquet").option(
                "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
            progress = [p for p in query.recentProgress if p["stateOperators"]]
            out.append(progress[-1]["stateOperators"][0] if progress else None)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)
    zero = int(spark.range(1).select(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))).first()[0])
    rows = spark.read.schema(worker.OUTPUT).parquet(str(tmp_path / "out")).collect()
    return sorted(((r.at_us - zero) // 1_000_000, r.job_id, r.action, r.attempts) for r in rows), out


def test_two_triggers_with_late_retry_and_lost_lease(spark, tmp_path):
    first = [(1, 1, "submitted", 0), (2, 1, "claimed", 10), (3, 1, "failed", 20), (4, 2, "submitted", 0), (5, 2, "claimed", 5),
             (6, 3, "submitted", 1), (7, 3, "claimed", 2), (8, 3, "succeeded", 3)]
    second = [(9, 1, "claimed", 700), (10, 1, "succeeded", 720), (11, 4, "submitted", 900), (12, 4, "claimed", 901)]
    actions, _ = run_events(spark, tmp_path, [first, second])
    assert actions == [(0, 1, "ready", 0), (0, 2, "ready", 0), (1, 3, "ready", 0), (3, 3, "done", 1), (22, 1, "ready", 1),
                       (305, 2, "lease_expired", 1), (720, 1, "done", 2), (900, 4, "ready", 0)]


def test_finished_jobs_leave_no_state(spark, tmp_path):
    rows = [(3 * j + n, j, kind, j * 10 + n) for j in range(60) for n, kind in enumerate(("submitted", "claimed", "succeeded"))]
    actions, states = run_events(spark, tmp_path, [[*rows, (999, 1000, "submitted", 700)]])
    assert Counter(a for _, _, a, _ in actions) == {"ready": 61, "done": 60}
    kept = worker.apply_event(("processing", 1, 5), "succeeded", 4)[0]
    assert kept is None and states[0]["numRowsTotal"] <= 2  # the open job alone


def test_fifth_failure_is_the_last():
    state, actions = None, []
    for n in range(6):
        state, _ = worker.apply_event(state, "claimed", n * 1000)
        state, action = worker.apply_event(state, "failed", n * 1000 + 1)
        actions.append(action)
        if state is None:
            break
    assert actions == [None] * 4 + ["dead"]


# ------------------------------------------------------------------------------------ degraded search
def test_failed_embedding_leaves_its_question_the_lexical_channel(spark, projected):
    def model(text, dimensions):
        if "fails" in text:
            raise TimeoutError("no answer")
        return [1.0, float(len(text))] if "short" not in text else [1.0]

    config = EngineConfig(embedding_model="own", embedding_dimensions=2, vector_min_similarity=None)
    index = cut_lineage(projected.withColumns({
        "lifecycle_status": F.lit("approved"), "embedding": F.array(F.lit(1.0).cast("float"), F.length("raw_text").cast("float")),
        "embedding_fingerprint": F.lit(config.embedding_fingerprint)}))
    asked = spark.createDataFrame([(1, "cedar river"), (2, "cedar river fails"), (3, "short cedar")], "query_id int, text string")
    found = retrieve.two_channels(index, asked, config, model, k=10).collect()
    modes = {r.query_id: (r.mode, r.error) for r in found}
    assert modes == {1: ("hybrid", None), 2: ("lexical_only", "TimeoutError: no answer"), 3: ("lexical_only", "embedding dimension mismatch: 1")}
    alone = {r.chunk_id for r in lexical.lexical_search(index, asked.filter("query_id = 2"), 10).collect()}
    assert {r.chunk_id for r in found if r.query_id == 2} == alone
    assert len([r for r in found if r.query_id == 1]) > 10


# ------------------------------------------------------------------------------------ files
def test_file_lookup_takes_more_partitions_for_more_rows(spark, monkeypatch):
    """What one task sorts is bounded by rows, not by a fixed number of partitions."""
    monkeypatch.setattr(cluster, "PART_ROWS", 10)
    versions = spark.range(200).selectExpr("concat('d', id) document_id", "concat('v', id) version_id", "timestamp_seconds(id) created_at")
    asked = spark.range(400).selectExpr("int(id) n", "concat('d', id % 200) document_id", "cast(null as timestamp) as_of", "cast(null as string) version_id")
    rows = catalog.file_as_of(asked, versions).select("n", "found_version", F.spark_partition_id().alias("p")).collect()
    assert {r.n: r.found_version for r in rows} == {n: f"v{n % 200}" for n in range(400)}
    assert len({r.p for r in rows}) > 40


def test_file_lookup_by_version_and_time(spark):
    rng = random.Random(4)
    day = datetime(2024, 1, 1)
    versions = [(f"d{rng.randrange(5)}", f"v{i:03d}", day + timedelta(hours=rng.randrange(100))) for i in range(60)]
    asked = [(i, f"d{rng.randrange(7)}", rng.choice([None, day + timedelta(hours=rng.randrange(-5, 110))]),
              rng.choice([None, None, f"v{rng.randrange(70):03d}"])) for i in range(300)]
    asked += asked[:5]
    got = catalog.file_as_of(spark.createDataFrame(asked, "n int, document_id string, as_of timestamp, version_id string").repartition(3),
                             spark.createDataFrame(versions, "document_id string, version_id string, created_at timestamp"))

    def expect(document, as_of, version):
        mine = [(at, v) for d, v, at in versions if d == document]
        if version is not None:
            return version if any(v == version for _, v in mine) else None
        return max(((at, v) for at, v in mine if as_of is None or at <= as_of), default=(None, None))[1]

    assert Counter((r.n, r.found_version) for r in got.collect()) == Counter((n, expect(d, t, v)) for n, d, t, v in asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


# ------------------------------------------------------------------------------------ publishing
def test_only_complete_versions_are_published(spark):
    schema = "version_id string, chunk_id string, ordinal int, record_hash string"
    chunks = [(v, f"{v}{i}", i, f"h{i}") for v in "abcde" for i in range(2)]
    stored = [c for c in chunks if c[1] != "b1"] + [("c", "c9", 9, "h")]
    stored = [(v, c, o + (c == "d1"), h) for v, c, o, h in stored]
    pending = spark.createDataFrame([(v,) for v in "abcd"], "version_id string")
    out = sync.verified(pending, spark.createDataFrame(chunks, schema), spark.createDataFrame(stored, schema))
    assert [r.version_id for r in out.collect()] == ["a"]


# ------------------------------------------------------------------------------------------ records
@pytest.fixture(scope="module")
def orders_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    day = datetime(1996, 1, 1)
    tables = {
        "nation": ([(0, "HERE"), (1, "THERE")], "n_nationkey int, n_name string"),
        "customer": ([(c, f"c{c}", c % 2, 10.0 * c, "BUILDING") for c in range(4)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(o, o % 4, "FOP"[o % 3], 1.0, day + timedelta(days=o), "1-URGENT") for o in range(12)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(o, 7 + o, 3, n, 5.0, 12.34, 0.0, 0.0, "R", "F", day if n < 3 else None) for o in [*range(13), 5] for n in (1, 2, 3)]
                     + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, None, "O", day)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_lines_are_joined_before_their_texts_are_made(spark, orders_folder):
    rows = record_rows(spark, orders_folder)
    assert "sha2(" not in rows._jdf.queryExecution().optimizedPlan().toString().partition("Join ")[2]
    owned = catalog.mark_current(kb.record_versions(spark, orders_folder)).join(kb.record_documents(spark, orders_folder), "document_id")
    wide = kb.record_chunks(spark, orders_folder).join(owned, "version_id").withColumn("is_searchable", is_searchable())
    assert Counter(map(tuple, rows.select(*wide.columns).collect())) == Counter(map(tuple, wide.collect()))


def test_versions_are_deleted_and_replaced_line_by_line(spark, orders_folder):
    known = {query.name: query.run for query in all_queries()}
    chunks = kb.record_chunks(spark, orders_folder).select("version_id", "ordinal", "chunk_id", "record_hash").collect()
    status = {r.version_id: r.lifecycle_status for r in kb.record_versions(spark, orders_folder).collect()}
    for name, want in (
            ("delete_versions", [(c.version_id, c.chunk_id, c.record_hash) for c in chunks if status.get(c.version_id) != "deprecated"]),
            ("projection_upsert", [(c.version_id, c.chunk_id, hashlib.sha256(c.record_hash.encode()).hexdigest()
                                    if status.get(c.version_id) == "draft" else c.record_hash)
                                   for c in chunks if status.get(c.version_id) != "draft" or c.ordinal > 1])):
        got = known[name](spark, orders_folder)
        assert Counter(map(tuple, got.select("version_id", "chunk_id", "record_hash").collect())) == Counter(want)


def shuffled(spark, df):
    """The plan of ``df`` as it is begun, without broadcasts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["reconcile_differences", "publish_cutover"])
def test_hashes_of_chunks_are_not_shuffled(spark, orders_folder, name):
    plan = shuffled(spark, getattr(registered, name)(spark, orders_folder))
    assert "Exchange hashpartitioning(concat(ORD-" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*chunk_id", plan)


def test_lines_are_dealt_without_the_name_of_their_version(spark, orders_folder):
    plan = shuffled(spark, registered.source_projection(spark, orders_folder)).split("\n")
    dealt = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(concat(ORD-" in line]
    assert len(dealt) == 1 and "version_id" not in "".join(plan[dealt[0]:dealt[0] + 3])


def test_repeated_and_missing_chunks_are_compared_like_a_join(spark):
    rng = random.Random(5)
    some = lambda *values: rng.choice([*values, None])
    schema = "version_id string, chunk_id string, ordinal int, record_hash string"
    for _ in range(4):
        mine, stored = ([(some(*"uvwxyz"), some(*"ab"), some(1, 1, 1, 2), some("h", "h", "h", "g")) for _ in range(n)] for n in (14, 12))
        pairs = [(m, None) for m in mine if not any(s[:2] == m[:2] and None not in m[:2] for s in stored)]
        known = [s for s in stored if s[0] is not None and any(s[0] == m[0] for m in mine)]
        pairs += [(None, s) for s in known if not any(s[:2] == m[:2] and None not in m[:2] for m in mine)]
        pairs += [(m, s) for m in mine for s in known if s[:2] == m[:2] and None not in m[:2]]
        want = {}
        for m, s in pairs:
            w = want.setdefault((m or s)[0], [0, 0, True])
            w[0] += bool(m and m[3])
            w[1] += bool(s and s[3])
            w[2] &= (m or (None,) * 4)[2:] == (s or (None,) * 4)[2:]
        rows = spark.createDataFrame(mine, schema).withColumns({
            "lifecycle_status": F.lit("draft"), "is_current": F.lit(False), "technical_status": F.lit("searchable"), "is_deleted": F.lit(False)})
        table = spark.createDataFrame(stored, schema)
        found = {r.version_id: [r.expected_chunks, r.indexed_chunks, r.manifest_matches] for r in sync.reconcile(rows, table).collect()}
        assert found == {v: w for v, w in want.items() if not w[2]}
        kinds = [(v,) for v in "uvwxyz"]
        whole = {v for v, in kinds if all(m and s and m[2:] == s[2:] for m, s in [
            *((m, s) for m, s in pairs if (m or s)[0] == v), *((None, s) for s in stored if s[0] == v and s not in known)])}
        published = sync.verified(spark.createDataFrame(kinds, "version_id string"), spark.createDataFrame(mine, schema), table)
        assert {r.version_id for r in published.collect()} == whole
