"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are lower-cased runs of letters. Words and their beginnings (of PREFIXES
bytes, for languages that inflect) are the units that the labelled texts score:
each gets the log-odds of the toxic against the other class, counted once for each
text that holds it (or texts that say one word thousands of times would decide),
under a Dirichlet prior of ``prior`` pseudo-counts shared as both classes together
share theirs, and FLOOR for each unit. Units whose odds don't differ by ``least_z``
standard deviations are left out. A token has the score of its longest known
unit; one without, or one that repeats the token before it, scores ``rest``, which
is below zero. In a text, the scan of Ruzzo and Tompa
finds all maximal-scoring segments in linear time. Scores of maximal segments of
clean text follow an extreme-value law (Karlin and Altschul's lambda and K). The
segments that the law finds significant are the passages; a text's statistic is
the -log of the chance that clean text of its length has its passages, and a
logistic curve turns it into a score between 0 and 1.

Everything that is fitted or chosen comes from the labelled rows that the caller
hands to ``fit``, and from no other:

* The rows are dealt by a hash of their id into FOLDS folds. For each fold the odds
  are learnt from the other folds, so the segments of every row come from odds
  that don't know it.
* Half of each fold (by another hash) gives the law, its clean rows; the other half
  gives the curve. No row serves both.
* ``prior``, ``least_z`` and ``rest`` are the triple of GRID with the least log loss of
  the curve, itself cross-validated over the curve's rows, on at most MAX_TUNE
  rows; of triples within a thousandth of the least loss, the first of GRID.
* The final odds are those of all rows; law and curve stay those of the folds.

The fit reads at most ``max_train`` labelled texts (those whose id has the least
hash), so the model is bounded: its token table goes to the executors, with its
size checked. To the driver come counted units and two numbers a training row,
never segments. Scoring covers every text in full, in the task that reads it.

A null or empty text has no tokens, hence no passage, and the score of a text
without any. Texts with a null id are scored, never trained on; rows that repeat an
id are all trained on, in one fold. Without usable
labels of both classes every text gets the share of toxic labels (0 without
labels). Rows that repeat are scored alike. Columns besides the id and the text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, plain_names, ship
from .words import Words, mix, slices

MAX_TRAIN = 20_000
PREFIXES = (8, 7, 6, 5)
PRIORS, LEAST_Z, RESTS = (100.0, 800.0), (5.0, 4.5, 4.0, 3.5, 3.0, 2.0), (-0.2, -0.05)
#: What ``fit`` chooses among, by cross-validation within its rows: prior, least z, score of an unknown token.
GRID = tuple((p, z, r) for p in PRIORS for z in LEAST_Z for r in RESTS)
FOLDS = 3
MAX_TUNE = 3000
FLOOR = 0.5
LEAST_COUNT = 3
MAX_TOKENS = 1 << 20
SIGNIFICANT = 0.05
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """tokens: sorted hashes; scores: of each (those below zero count as ``rest`` at most); rest: score of any other token; lam, k: of the extreme-value law; a, b: of the logistic curve."""

    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = -0.1
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = 0.0
    constant: float | None = None


class Tokens(Words):
    """Runs of letters: ASCII letters and all bytes of other characters."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(np.where(_LETTER[data], data, np.uint8(32)), bounds)


def token_slices(column: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    for i, j, words in slices(column):
        yield i, j, Tokens(words.data, words.bounds)


def maximal_segments(places: np.ndarray, totals: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a token sequence.

    places: of the tokens with a positive score, in order; totals: for each the
    running total before it and with it. Only positive tokens can begin or end a segment, so the scan visits
    just these; each is pushed once and merged at most once.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    for place, (before, after) in zip(places.tolist(), totals.tolist(), strict=True):
        first, left, right = place, before, after
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, place, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, last, right - left) for f, last, left, right in stack]


def unit_hashes(tokens: Tokens) -> list[np.ndarray]:
    """The hashes of the tokens' units, the longest first."""
    return [tokens.hashes(lower=True), *tokens.prefix_hashes(PREFIXES, lower=True)]


def grid_scores(models: list[Model], tokens: Tokens) -> Iterator[np.ndarray]:
    """The tokens' scores in each model; hashes are made once."""
    units = unit_hashes(tokens)
    said = np.append(False, (units[0][1:] == units[0][:-1]) & (tokens.doc[1:] == tokens.doc[:-1]))[: len(units[0])]
    for model in models:
        out = np.full(len(tokens.starts), model.rest)
        if len(model.tokens):
            open_ = np.ones(len(out), bool)
            for h in units:
                at = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
                known = open_ & (model.tokens[at] == h)
                own = model.scores[at[known]]
                out[known] = np.where(own > 0, own, np.minimum(own, model.rest))
                open_ &= ~known
            out[said] = np.minimum(out[said], model.rest)
        yield out


def token_scores(model: Model, tokens: Tokens) -> np.ndarray:
    return next(grid_scores([model], tokens))


def segments_of(model: Model, own: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal segments of one text, from its tokens' scores."""
    places = np.flatnonzero(own > 0)
    if not len(places):
        return []
    total = np.append(0.0, np.cumsum(own))
    return maximal_segments(places, np.stack([total[places], total[places + 1]], axis=1))


def _statistic(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-log10 of the chance of the best passages in clean text of n tokens; the significant passages with their chances."""
    kept, total = [], 0.0
    for first, last, score in found:
        expected = model.k * max(n, 1) * math.exp(-model.lam * score)
        chance = -math.expm1(-expected)
        if chance <= SIGNIFICANT:
            kept.append((first, last, score, chance))
            total -= math.log10(max(chance, 1e-300))
    if not kept and found:
        best = max(s for _, _, s in found)
        total = -math.log10(-math.expm1(-model.k * max(n, 1) * math.exp(-model.lam * best)))
    return min(total, 30.0), kept


def _score(model: Model, statistic: float) -> float:
    if model.constant is not None:
        return model.constant
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, model.a * statistic + model.b))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, token, n0, n1): texts of either class that hold the token, summed by slice."""
    for batch in batches:
        fold = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, tokens in token_slices(batch.column(0)):
            units = unit_hashes(tokens)
            fresh = [np.ones(len(units[0]), bool), *(tokens.ends - tokens.starts > size for size in PREFIXES)]
            h = np.concatenate([u[f] for u, f in zip(units, fresh, strict=True)])
            doc = np.concatenate([tokens.doc[f] for f in fresh])
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            of, where = toxic[i:j][doc[once]], fold[i:j][doc[once]]
            for f in range(FOLDS):
                here = where == f
                value, at = np.unique(h[once][here], return_inverse=True)
                n1 = np.bincount(at, weights=of[here], minlength=len(value)).astype(np.int64)
                n0 = np.bincount(at, weights=1 - of[here], minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f, np.int32)), pa.array(value.view(np.int64)), pa.array(n0), pa.array(n1)], ["fold", "token", "n0", "n1"])


ROLES = {"law": 0, "curve": 1}


def _by_row(models: list[list[Model]], value):
    """(toxic, n, values): ``value(model, segments, n)`` of a training row in each of its fold's models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            values, sizes = np.zeros((len(batch), len(models[0]))), np.zeros(len(batch), np.int64)
            for i, j, tokens in token_slices(batch.column(0)):
                sizes[i:j] = tokens.counts
                for f in np.unique(fold[i:j]).tolist():
                    mine = fold[i:j] == f
                    for m, scored in enumerate(grid_scores(models[f], tokens)):
                        model = models[f][m]
                        values[i:j, m][mine] = value(model, [], 0)
                        live = np.unique(tokens.doc[scored > 0])  # the other rows have no segment
                        for d in live[mine[live]].tolist():
                            own = scored[tokens.first[d] : tokens.first[d + 1]]
                            values[i + d, m] = value(model, segments_of(model, own), len(own))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sizes), pa.array(values.tolist(), pa.list_(pa.float64()))], ["toxic", "n", "found"])

    return run


def _best(model: Model, found: list, n: int) -> float:
    return max((score for _, _, score in found), default=0.0)


def _strength(model: Model, found: list, n: int) -> float:
    return _statistic(model, found, n)[0]


def _law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K of the best segment's law P(S >= x) = 1 - exp(-K n exp(-lambda x)), by the tail above the median of clean texts."""
    live = best > 0
    if live.sum() < 30:
        return 1.0, 0.1
    # With u = x - log(n) / lambda the law is Gumbel; a few fixed-point turns settle lambda.
    lam = 1.0
    for _ in range(40):
        u = best[live] - np.log(np.maximum(n[live], 1)) / lam
        lam = min(5.0, max(0.2, 0.5 * lam + 0.5 * math.pi / (math.sqrt(6) * max(u.std(), 1e-3))))
    u = best - np.log(np.maximum(n, 1)) / lam
    k = float(np.exp(lam * (np.median(u[live]) + math.log(math.log(2)) / lam))) * live.mean()
    return float(lam), max(k, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight pull to zero; the classes weigh as they are."""
    w = np.zeros(2)
    X = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + np.array([0.05, 0.0]) * w
        H = (X * (p * (1 - p))[:, None]).T @ X + np.diag([0.05, 1e-6])
        step = np.linalg.solve(H, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def log_loss(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> float:
    """The curve's mean log loss on each part, fitted on the others."""
    total = 0.0
    for p in np.unique(part):
        test = part == p
        a, b = _logistic(x[~test], y[~test])
        chance = np.clip(1 / (1 + np.exp(-np.clip(a * x[test] + b, -500, 500))), 1e-6, 1 - 1e-6)
        total -= float(np.sum(y[test] * np.log(chance) + (1 - y[test]) * np.log(1 - chance)))
    return total / max(len(x), 1)


def _odds(n0: Column, n1: Column, all0: int, all1: int, prior: float) -> tuple[Column, Column]:
    """The log-odds of a unit that n0 and n1 texts hold, and their number of standard deviations."""
    alpha = F.lit(FLOOR) + F.lit(prior) * (n0 + n1) / F.lit(float(all0 + all1))
    odds = lambda n, of: F.log((n + alpha) / (F.lit(float(of)) + F.lit(prior) - n - alpha))
    delta = odds(n1, all1) - odds(n0, all0)
    return delta, delta / F.sqrt(F.lit(1.0) / (n1 + alpha) + F.lit(1.0) / (n0 + alpha))


def _models(counts: DataFrame, sets: list[int], grid: list[tuple[float, float, float]]) -> list[list[Model]]:
    """For each of ``sets`` a model without law and curve for each triple of ``grid``, from counted units (token, and n0_, n1_ of each set)."""
    totals = counts.agg(*[F.coalesce(F.sum(f"n{c}_{s}"), F.lit(0)).alias(f"n{c}_{s}") for s in sets for c in (0, 1)]).first()
    columns, strong = [], F.lit(0.0)
    for s in sets:
        n0, n1 = F.col(f"n0_{s}"), F.col(f"n1_{s}")
        for p, prior in enumerate(dict.fromkeys(g[0] for g in grid)):
            delta, z = _odds(n0, n1, totals[f"n0_{s}"], totals[f"n1_{s}"], prior) if totals[f"n0_{s}"] and totals[f"n1_{s}"] else (F.lit(0.0), F.lit(0.0))
            z = F.when(n0 + n1 >= LEAST_COUNT, F.abs(z)).otherwise(0.0)
            columns += [delta.alias(f"d_{s}_{p}"), z.alias(f"z_{s}_{p}")]
            strong = F.greatest(strong, z)
    table = counts.select("token", *columns, strong.alias("strong")).where(F.col("strong") >= min(g[1] for g in grid))
    table = table.orderBy(F.desc("strong"), "token").limit(MAX_TOKENS).toPandas()
    token = table["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    out = []
    for s in sets:
        kept = {}  # models that differ in ``rest`` alone share their arrays
        for p, prior in enumerate(dict.fromkeys(g[0] for g in grid)):
            delta, z = (table[f"{c}_{s}_{p}"].to_numpy(np.float64)[order] for c in "dz")
            for least in {g[1] for g in grid}:
                kept[prior, least] = token[order][z >= least], np.clip(delta, -4, 8)[z >= least]
        out.append([Model(*kept[prior, least], rest=rest) for prior, least, rest in grid])
    return out


def _calibrated(rows: DataFrame, models: list[list[Model]]) -> tuple[np.ndarray, np.ndarray]:
    """Give each fold's models their law, from the law's rows of all folds; the curve's rows (statistics by model, toxic)."""
    of = lambda role, value: rows.where(F.col("role") == ROLES[role]).select("text", "fold", "toxic").mapInArrow(_by_row(models, value), "toxic int, n long, found array<double>")
    seen = of("law", _best).where("toxic = 0").toPandas()
    best, n = np.array(seen["found"].tolist(), np.float64).reshape(len(seen), -1), seen["n"].to_numpy(np.float64)
    for m in range(len(models[0])):
        lam, k = _law(n, best[:, m]) if len(seen) else (1.0, 0.1)
        for fold in models:
            fold[m].lam, fold[m].k = lam, k
    held = of("curve", _strength).toPandas()
    x = np.array(held["found"].tolist(), np.float64).reshape(len(held), len(models[0]))
    y = held["toxic"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit must not depend on it
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows ``labels`` (doc_id, toxic) of ``docs``. At most ``max_train`` ids are read."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    fold, role = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int"), F.pmod(F.xxhash64("_id", F.lit("role")), F.lit(len(ROLES))).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))
    rows = scratch.cut(rows.select("text", fold.alias("fold"), role.alias("role"), F.col("_toxic").alias("toxic"), F.xxhash64("_id", F.lit("tune")).alias("turn")), "train")
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return Model(constant=float(next(iter(classes), 0)))
    counts = rows.select("text", "fold", "toxic").mapInArrow(_counts, "fold int, token long, n0 long, n1 long")
    of = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}")
    counts = scratch.cut(counts.groupBy("token").agg(*[of(c, f) for f in range(FOLDS + 1) for c in ("n0", "n1")]), "counts")  # the last set is all rows
    share = MAX_TUNE / sum(classes.values())
    tune = rows if share >= 1 else rows.where(F.pmod("turn", F.lit(1 << 20)) < int(share * (1 << 20)))
    x, y = _calibrated(tune, _models(counts, list(range(FOLDS)), list(GRID)))
    chosen = GRID[len(GRID) // 2]
    part = np.arange(len(y)) % 5  # rows are ordered by class, so each part has both
    if len(y) >= 20 and 0 < y.sum() < len(y):
        losses = np.array([log_loss(x[:, m], y, part) for m in range(len(GRID))])
        chosen = GRID[int(np.argmax(losses <= losses.min() + 1e-3))]
    *folds, (model,) = _models(counts, list(range(FOLDS + 1)), [chosen])
    x, y = _calibrated(rows, folds)
    model.lam, model.k = folds[0][0].lam, folds[0][0].k
    if len(y) and 0 < y.sum() < len(y):
        model.a, model.b = _logistic(x[:, 0], y)
    else:
        model.constant = classes[1] / (classes[0] + classes[1])
    scratch.drop(rows, counts)
    return model


SCORED = "doc_id long, score double, n_passages long, passages array<struct<start: long, end: long, score: double, chance: double, text: string>>"


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64()), ("text", pa.string())]))
        for batch in batches:
            for i, j, tokens in token_slices(batch.column(1)):
                own = token_scores(model, tokens)
                live = np.unique(tokens.doc[own > 0])  # the other texts have no segment
                none = _score(model, 0.0)
                scores, passages = np.full(j - i, none), [[] for _ in range(j - i)]
                for d in live.tolist():
                    low, high = tokens.first[d], tokens.first[d + 1]
                    found = segments_of(model, own[low:high])
                    statistic, kept = _statistic(model, found, int(high - low))
                    scores[d] = _score(model, statistic)
                    text = batch.column(1)[i + d].as_py().encode()
                    base = int(tokens.bounds[d])
                    for first, last, score, chance in kept:
                        a, b = int(tokens.starts[low + first]) - base, int(tokens.ends[low + last]) - base
                        quote = text[a:b].decode("utf-8", "replace")
                        start = len(text[:a].decode("utf-8", "replace"))
                        passages[d].append({"start": start, "end": start + len(quote), "score": score, "chance": chance, "text": quote})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores), pa.array([len(p) for p in passages], pa.int64()), pa.array(passages, passage)], ["doc_id", "score", "n_passages", "passages"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_passages, passages`` (code-point offsets into the text) for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    if len(model.tokens) > MAX_TOKENS:
        raise ValueError(f"{len(model.tokens)} tokens are more than the {MAX_TOKENS} that may go to every executor")
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scored(shared), SCORED)


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    if len(model.tokens) > MAX_TOKENS:
        raise ValueError(f"{len(model.tokens)} tokens are more than the {MAX_TOKENS} that may go to every executor")
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(shared)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["doc_id", "text"])
            chances = [c for out in score(iter([pair])) for c in out.column(1).to_pylist()]
            yield batch.filter(pa.array([c < threshold for c in chances], pa.bool_()))

    return plain_names(docs).mapInArrow(keep, docs.schema)
