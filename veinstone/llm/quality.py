"""Quality classifier: co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.batches import slices
from veinstone.llm.common import Cuts
from veinstone.llm.trees import BoostedTrees

N_TEXT = 16
#: Slots for languages, sources and size classes.
SLOTS = (32, 256, 8)
_SCHEMA = "doc_id long, text_view array<float>, meta_view array<float>"


def text_features(text: str) -> list[float]:
    """Statistics of a whole text that do not depend on its language; zeros for an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * N_TEXT
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high, blanks = count[128:].sum(), count[9:14].sum() + count[32]
    stops = count[[46, 44, 59, 58]].sum()
    symbols = n - upper - lower - digits - high - blanks - stops
    words = raw.split()
    n_words = max(1, len(words))
    kinds = len(set(words))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = raw.split(b"\n")
    ends = count[[46, 33, 63]].sum()
    p = count[count > 0] / n
    return [upper / n, digits / n, high / n, stops / n, symbols / n, count[33] / n, count[124] / n, count[35:39].sum() / n,
            min(1.0, (n - blanks) / n_words / 20), kinds / n_words, kinds / n_words**0.7 / 8, repeated / n_words,
            len(set(lines)) / len(lines), min(1.0, ends / n_words), float(-(p * np.log2(p)).sum()) / 8,
            min(1.0, np.log1p(n) / 15)]


@lru_cache(maxsize=65_536)
def _slot(value: str | None, slots: int) -> float:
    """A slot by a hash of the whole value; -1 for none."""
    if value is None:
        return -1.0
    return float(int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest()) % slots)


def meta_features(lang: str | None, source: str | None, size: int) -> list[float]:
    """A page's metadata: the slots of language, source and size class."""
    return [_slot(lang, SLOTS[0]), _slot(source, SLOTS[1]), float(min(SLOTS[2] - 1, int(np.log10(1 + size) * 1.6)))]


def views(documents: DataFrame) -> DataFrame:
    """doc_id and both views of every document, from one scan of the whole texts."""
    def run(batches):
        for batch in slices(batches):
            ids, texts, langs, sources = batch.columns
            a, b = [], []
            for text, lang, source in zip(texts, langs, sources, strict=True):
                t = text.as_py() or ""
                a.append(text_features(t))
                b.append(meta_features(lang.as_py(), source.as_py(), len(t)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(a, pa.list_(pa.float32())), pa.array(b, pa.list_(pa.float32()))],
                names=["doc_id", "text_view", "meta_view"])

    return documents.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(run, _SCHEMA)


class View:
    """A classifier of one view with log-odds calibrated on held-out labels."""

    a, b = 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A slope (not negative) and an intercept that fit the labels, softened at the ends."""
        s = self.raw(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            c = p * (1 - p) + 1e-6
            h = np.array([[(c * s * s).sum() + 1e-3, (c * s).sum()], [(c * s).sum(), c.sum() + 1e-3]])
            step = np.linalg.solve(h, [((p - target) * s).sum() + 1e-3 * (a - 1), (p - target).sum()])
            a, b = a - step[0], b - step[1]
        self.a, self.b = (a, b) if a > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


class TextView(View):
    """Boosted trees over the statistics of the text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.trees = BoostedTrees(rounds=60, depth=3, rate=0.2, bins=64).fit(x, y, weight)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.trees.logit(x)


class MetaView(View):
    """Ridge-penalised logistic regression over the metadata slots."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-3):
        z, w = self._expand(x), np.zeros(1 + sum(SLOTS))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = weight * p * (1 - p) + 1e-6
            step = np.linalg.solve((z * curve[:, None]).T @ z + strength * len(y) * np.eye(len(w)),
                                   z.T @ (weight * (p - y)) + strength * len(y) * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    @staticmethod
    def _expand(x):
        out, start = np.zeros((len(x), 1 + sum(SLOTS))), 1
        out[:, 0] = 1
        for column, slots in zip(x.T.astype(int), SLOTS, strict=True):
            known = np.flatnonzero(column >= 0)
            out[known, start + column[known]] = 1
            start += slots
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, start = np.full(len(x), self.w[0]), 1
        for column, slots in zip(x.T.astype(int), SLOTS, strict=True):
            total += np.where(column >= 0, self.w[start + np.maximum(column, 0)], 0.0)
            start += slots
        return total


def log_odds(seen: DataFrame, models: dict[str, View], *keep: str) -> DataFrame:
    """The columns ``keep`` and both views' calibrated log-odds, s_text_view and s_meta_view."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = []
            for name, model in models.items():
                column = batch.column(batch.schema.names.index(name))
                scores.append(pa.array(model.log_odds(
                    np.asarray(column.flatten(), float).reshape(batch.num_rows, -1))))
            kept = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *scores], names=[*keep, *(f"s_{v}" for v in models)])

    types = dict(seen.dtypes)
    columns = [f"{c} {types[c]}" for c in keep] + [f"s_{v} double" for v in models]
    return seen.select(*dict.fromkeys((*keep, *models))).mapInArrow(run, ", ".join(columns))


def _arrays(rows, view):
    return np.array([r[view] for r in rows], np.float64)


def examples(scored: DataFrame, v: str, other: str, bound: float, handed: list) -> DataFrame:
    """Distinct examples of view ``other`` from all documents of which view ``v`` is sure: (other, label, copies,
    name), without those named in ``handed``, in the order of their names (hashes)."""
    score = F.col(f"s_{v}")
    sure = (scored.filter(F.abs(score) > bound).select(other, F.when(score > 0, 1.0).otherwise(0.0).alias("label"))
            .groupBy(other, "label").agg(F.count("*").alias("copies")).withColumn("name", F.xxhash64(other, "label")))
    if handed:
        sure = sure.join(F.broadcast(scored.sparkSession.createDataFrame(handed, "name long")), "name", "left_anti")
    return sure.orderBy("name", other)


def fit(cuts: Cuts, seen: DataFrame, labels: DataFrame, labelled_rows: int = 10_000, rounds: int = 3,
        exchanged: int = 10_000, sure: float = 0.97, reject_below: float = 0.25) -> tuple[View, View, float, float]:
    """Both calibrated views, the prior log-odds and the threshold.

    At most ``labelled_rows`` labelled documents (chosen by hash; a fifth is held out for calibration
    and threshold) come to the driver. In each round every unlabelled document is scored by both views.
    Those of which a view is surer than ``sure`` are aggregated to distinct examples of the other view,
    with counts; all that were not handed over before are, up to ``exchanged`` a view and round (beyond
    that chosen by hash). A text counts once however often it is copied, a metadata cell by its
    documents. All examples together weigh half of the labels at most, and half of a label each on average.
    """
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y")))
    rows = (seen.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit("label")), "doc_id", "text_view")
            .limit(labelled_rows).select("text_view", "meta_view", "y").collect())
    if len({r.y for r in rows}) < 2:
        return None
    y = np.array([r.y for r in rows], float)
    x = {v: _arrays(rows, v) for v in ("text_view", "meta_view")}
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    pool = seen.join(known, "doc_id", "left_anti")
    extra = {v: (np.zeros((0, x[v].shape[1])), np.zeros(0), np.zeros(0)) for v in x}
    handed: dict[str, list] = {v: [] for v in x}

    kinds = {"text_view": TextView, "meta_view": MetaView}

    def trained():
        out = {}
        for v in x:
            more, more_y, count = extra[v]
            # half of a label each on average, and no more than half of the labels together
            share = 0.5 * count / max(1.0, count.mean(), count.sum() / (~held).sum()) if len(count) else count
            model = kinds[v](np.concatenate([x[v][~held], more]), np.concatenate([y[~held], more_y]),
                         np.concatenate([np.ones((~held).sum()), share]))
            model.calibrate(x[v][check], y[check])
            out[v] = model
        return out

    models = trained()
    bound = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        scored = cuts.keep(log_odds(pool, models, "doc_id", "text_view", "meta_view"))
        found = 0
        for v, other in (("text_view", "meta_view"), ("meta_view", "text_view")):
            best = examples(scored, v, other, bound, handed[other]).limit(exchanged).collect()
            if best:
                old, old_y, count = extra[other]
                copies = [r.copies if other == "meta_view" else 1 for r in best]
                extra[other] = (np.concatenate([old, _arrays(best, other)]), np.append(old_y, [r.label for r in best]), np.append(count, copies))
                handed[other] += [(r.name,) for r in best]
                found += len(best)
        cuts.drop(scored)
        if not found:
            break
        models = trained()
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    both = sum(m.log_odds(x[v][check]) for v, m in models.items()) - prior
    good = np.sort(both[y[check] > 0])
    # rejected below this probability, or below the lowest hundredth of good held-out ones if that is lower
    threshold = min(float(np.log(reject_below / (1 - reject_below))), float(good[int(0.01 * len(good))]))
    return models["text_view"], models["meta_view"], prior, threshold


def score_documents(documents: DataFrame, labels: DataFrame, cuts: Cuts | None = None, **how) -> DataFrame:
    """Scores of all documents: doc_id, text_score, meta_score, score (probability of good quality), keep.

    ``score`` adds the calibrated log-odds of both views, less the prior that both contain. Null and
    empty texts are scored as empty ones; unknown languages and sources are nulls; labels that are
    null or of unknown documents are left out, a document with several labels is good if one says so.
    Without labels of both classes every score is null and every document is kept. Equal rows get equal
    scores, an empty table no rows; other columns are not read.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    seen = cuts.keep(views(documents))
    fitted = fit(cuts, seen, labels, **how)
    if fitted is None:
        none = F.lit(None).cast("double")
        return seen.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"),
                           F.lit(True).alias("keep"))
    text, meta, prior, threshold = fitted
    a, b = F.col("s_text_view"), F.col("s_meta_view")
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    return log_odds(seen, {"text_view": text, "meta_view": meta}, "doc_id").select(
        "doc_id", sigmoid(a).alias("text_score"), sigmoid(b).alias("meta_score"),
        sigmoid(a + b - F.lit(prior)).alias("score"), (a + b - F.lit(prior) >= F.lit(threshold)).alias("keep"))


def keep_good(documents: DataFrame, labels: DataFrame, cuts: Cuts | None = None, **how) -> DataFrame:
    """``documents`` without the rejected ones.

    A document's verdict depends on its own row alone, so the fitted views judge the rows in the scan:
    nothing is joined or shuffled.
    """
    cuts = cuts or Cuts(documents.sparkSession)
    seen = cuts.keep(views(documents))
    fitted = fit(cuts, seen, labels, **how)
    if fitted is None:
        return documents
    text, meta, prior, threshold = fitted
    names = documents.columns

    def run(batches):
        for batch in slices(batches):
            columns = [batch.column(names.index(c)) for c in ("text", "lang", "source")]
            texts, metas = [], []
            for t, lang, source in zip(*columns, strict=True):
                t = t.as_py() or ""
                texts.append(text_features(t))
                metas.append(meta_features(lang.as_py(), source.as_py(), len(t)))
            if not texts:
                continue
            a, b = np.float32(texts).astype(float), np.float32(metas).astype(float)
            total = text.log_odds(a) + meta.log_odds(b) - prior
            yield batch.filter(pa.array(total >= threshold))

    return documents.mapInArrow(run, documents.schema)
