"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts, group_key, with_position, word_count

#: A cell's documents are ranked in shards of about so many rows.
SHARD_ROWS = 256
EXACT = "decimal(38,9)"


def _copies(lam: Column, size: Column, scale: Column, most: float) -> Column:
    """The tilted rate of a document: exp(lambda * size / scale), at most ``most`` copies."""
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def targets(cuts: Cuts, cells: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: src, source_size, n_docs, target.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``most`` times its source's size and its excess goes to the others by
    weight. That ends at min(most * size, weight * level) with one common level, found by capping the
    sources above the level until none is. Sums of whole numbers only, so reruns agree.
    """
    sizes = cells.groupBy("src").agg(
        F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("n_docs"))
    placed = with_position(cuts, sizes, F.col("source").asc_nulls_last(), F.col("src"))
    by_turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("position", F.lit(len(weights))).cast("int"))
    placed = cuts.keep(placed.withColumn("weight", by_turn))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = placed.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("kept"),
                         F.count_if(full).alias("capped"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row.capped == capped or not row.open:
            break
        capped, level = row.capped, max(0.0, share * total - most * row.kept) / row.open
    return placed.select("src", "source_size", "n_docs",
                         F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def balance(cuts: Cuts, cells: DataFrame, goals: DataFrame, most: float, rounds: int = 80) -> DataFrame:
    """Per source its target, scale and the multiplier ``lam`` that meets the token constraint.

    The entropy problem (rates close to one copy, at most ``most``, tokens of each source equal to its
    target) has a convex dual with one multiplier a source. Each distributed Newton step sums the
    dual's gradient and curvature over the histogram of (source, size); a step that leaves the known
    bracket is replaced by its middle. Sums are decimals: the order of rows does not change them.
    """
    gap, slope = F.col("got") - F.col("target"), F.col("slope")
    state = goals.withColumns({
        "scale": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)),
        "lam": F.when((F.col("source_size") > 0) & (F.col("target") > 0),
                      F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)),
        "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(None).cast("double")})
    state = cuts.keep(state)
    for _ in range(rounds):
        rate = _copies(F.col("lam"), F.col("size"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * rate
        sums = cells.join(state.select("src", "lam", "scale"), "src").groupBy("src").agg(
            F.sum(words.cast(EXACT)).cast("double").alias("got"),
            F.sum(F.when(rate < most, words * F.col("size") / F.col("scale")).otherwise(0.0).cast(EXACT))
            .cast("double").alias("slope"))
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.when(slope > 0, F.col("lam") - gap / slope)
        inside = (newton > F.coalesce("low", F.lit(-1e300))) & (newton < F.coalesce("high", F.lit(1e300)))
        step = F.when(inside & (F.abs(newton - F.col("lam")) <= 4), newton).when(
            F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(
            F.col("lam") - F.signum(gap) * F.greatest(F.lit(1.0), F.abs(F.col("lam"))))
        off = F.abs(gap) / F.greatest(F.col("source_size").cast("double"), F.lit(1.0))
        state_next = (state.drop("off").join(sums, "src")
                      .withColumns({"off": off, "low": low, "high": high})
                      .withColumn("lam", F.when(F.col("off") > 1e-9, F.round(step, 12)).otherwise(F.col("lam")))
                      .drop("got", "slope"))
        state_next = cuts.keep(state_next)
        worst = state_next.agg(F.max("off")).first()[0]
        cuts.drop(state)
        state = state_next
        if worst is None or worst <= 1e-9:
            break
    return state.select("src", "source_size", "target", "scale", "lam")


def _cell_copies(cuts: Cuts, cells: DataFrame, tilts: DataFrame, most: int, rounds: int = 12) -> DataFrame:
    """Whole copies for each cell (src, size, n): column ``copies``, summing near the source's target.

    Expected copies are accumulated from the largest size down and rounded as they go; what is then
    missing or over is settled with copies of the largest sizes that still fit into the gap.
    """
    down = Window.partitionBy("src").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = (F.col("n") * _copies(F.col("lam"), F.col("size"), F.col("scale"), most)).cast(EXACT)
    half = F.lit(0.5).cast(EXACT)
    done = cells.select("src", "size", "n").join(tilts, "src").withColumn("want", want).withColumn(
        "sum", F.sum("want").over(down))
    whole = (F.floor(F.col("sum") + half) - F.floor(F.col("sum") - F.col("want") + half)).cast("long")
    done = cuts.keep(done.select("src", "size", "n", F.floor("target").cast("long").alias("goal"), "target", "source_size",
                                 F.least(whole, F.col("n") * most).alias("copies")))
    for _ in range(rounds):
        gaps = done.groupBy("src", "goal").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).select(
            "src", (F.col("goal") - F.col("got")).alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0)
        best = F.max(F.when(fits, F.struct("size", F.least(room, F.floor(F.abs("gap") / F.col("size"))).alias("move"),
                                           F.signum("gap").cast("long").alias("sign"))))
        moves = cuts.keep(done.join(gaps, "src").filter(F.abs("gap") > F.col("goal") * 1e-4)
                          .groupBy("src").agg(best.alias("m")).filter("m IS NOT NULL")
                          .select("src", F.col("m.size").alias("size"), (F.col("m.move") * F.col("m.sign")).alias("move")))
        if moves.isEmpty():
            break
        following = cuts.keep(done.join(moves, ["src", "size"], "left").withColumn(
            "copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))
        cuts.drop(done, moves)
        done = following
    return done


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
                most: int = 2, cuts: Cuts | None = None) -> DataFrame:
    """Copies of every document so that sources meet their targets.

    Returns one row per document: doc_id, src (the source's key), size (words), source_size, target,
    copies, taken = copies * size. Null texts and texts without words have size 0. A null source is a
    source of its own. Repeated rows are documents of their own; equal rows may differ in copies. An
    empty table gives no rows. Other columns are not read.

    The text is scanned once for the sizes; all later steps work on narrow rows or on the histogram
    of (source, size), which a hot source does not make longer. A document's copies are its cell's
    copies dealt by a hash of its id, in shards of a few hundred rows.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    docs = cuts.keep(documents.select(
        "doc_id", "source", group_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size")))
    cells = cuts.keep(docs.groupBy("src", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    tilts = balance(cuts, cells, targets(cuts, cells, weights, share, most), most)
    plan = _cell_copies(cuts, cells, tilts, most)

    shards = F.ceil(F.col("n") / SHARD_ROWS)
    dealt = docs.drop("source").join(plan, ["src", "size"]).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), shards))
    dealt = cuts.keep(dealt.withColumns({"base": F.floor(F.col("copies") / F.col("n")), "extra": F.pmod("copies", "n")}))
    upto = Window.partitionBy("src", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("src", "size", "shard", "extra", "n").agg(F.count("*").alias("c")).withColumn(
        "sum", F.sum("c").over(upto))
    part = lambda c: F.expr(f"({c} * extra) div n")
    parts = parts.select("src", "size", "shard", (part("sum") - part("(sum - c)")).alias("more"))
    inside = Window.partitionBy("src", "size", "shard").orderBy(F.xxhash64("doc_id", F.lit("copy")), "doc_id")
    return (dealt.join(parts, ["src", "size", "shard"])
            .withColumn("rank", F.row_number().over(inside))
            .withColumn("copies", F.col("base") + (F.col("rank") <= F.col("more")).cast("long"))
            .select("doc_id", "src", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def repeat_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """``documents`` with each row as often as ``mixed`` (of the same documents) says.

    Texts are shuffled once: to how many rows of an id, source and size have which number of copies. Rows
    that share all three are told apart by their turn there, where they lie.
    """
    key = ["_id", "src", "size"]
    dealt = mixed.groupBy(group_key(F.col("doc_id")).alias("_id"), "src", "size", "copies").agg(F.count("*").alias("n"))
    times = dealt.groupBy(*key).agg(F.collect_list(F.struct("copies", "n")).alias("times")).filter(
        F.exists("times", lambda t: t["copies"] > 0))
    rows = documents.select(group_key(F.col("doc_id")).alias("_id"), group_key(F.col("source")).alias("src"),
                            word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    nobody = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("copies"))

    def reach(done, t):
        upto = done["upto"] + t["n"]
        own = (F.col("turn") > done["upto"]) & (F.col("turn") <= upto)
        return F.struct(upto.alias("upto"), F.when(own, t["copies"]).otherwise(done["copies"]).alias("copies"))

    copies = F.aggregate("times", nobody, reach)["copies"]
    return (rows.join(times, key).withColumn("turn", turn).select("row", copies.alias("copies")).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*"))
