"""The additive model: bins, terms, scores, and their learner.

A model is plain data. Scoring is one select: a bin per feature (binary search on the
JVM) and a lookup in a literal array per term; no join, no shuffle, no Python.

Training follows the published additive-boosting papers (Lou et al. 2012 and 2013, Nori
et al. 2019): cyclic boosting of one-feature trees, then of chosen pairs, in bags. Bags
are independent groups of one ``applyInPandas``; a bag sees about ``bag_rows`` rows
at most, picked by a hash of content and occurrence. Histograms for cuts, pair choice, centring and importances are
aggregations over all rows.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.profile import col
from lumenframe.operators.split import numbered

BAG_ROWS = 1_000_000


@dataclass
class Term:
    features: list[str]
    scores: list  # per class: a list by bin, or a list of lists for a pair
    importance: float = 0.0

    @property
    def name(self) -> str:
        return " & ".join(self.features)

    @property
    def is_interaction(self) -> bool:
        return len(self.features) > 1


@dataclass
class AdditiveModel:
    """Bin 0 is missing or unknown and scores 0 where training had none. ``cuts`` hold a
    continuous feature's inner edges, ``coarse`` those of its pair tables, ``levels`` a
    nominal feature's categories. Binary models have one score set, for class 1."""

    classes: list
    intercept: list[float]
    cuts: dict[str, list[float]] = field(default_factory=dict)
    coarse: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    terms: list[Term] = field(default_factory=list)
    ranges: dict[str, list[float]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> AdditiveModel:
        raw = json.loads(text)
        raw["terms"] = [Term(**t) for t in raw["terms"]]
        return cls(**raw)

    @property
    def features(self) -> list[str]:
        return [*self.cuts, *self.levels]

    @property
    def n_scores(self) -> int:
        return len(self.intercept)


def bin_frame(df: DataFrame, cuts: dict[str, list[float]], levels: dict[str, list[str]], prefix: str = "b_") -> DataFrame:
    """``df`` with an integer bin column per feature: 0 for missing or unknown, then the
    bins in order. Continuous bins are closed below."""
    numbers = [f for f in cuts if cuts[f]]
    out = df
    if numbers:
        inputs = {f"{prefix}x{i}": F.coalesce(col(f).cast("double"), F.lit(float("nan"))) for i, f in enumerate(numbers)}
        out = out.withColumns(inputs)
        splits = [[-float("inf"), *cuts[f], float("inf")] for f in numbers]
        made = [f"{prefix}y{i}" for i in range(len(numbers))]
        out = Bucketizer(splitsArray=splits, inputCols=list(inputs), outputCols=made, handleInvalid="keep").transform(out)
        bins = {f"{prefix}{f}": F.when(F.isnan(F.col(x)), 0).otherwise(F.col(y) + 1).cast("int") for f, x, y in zip(numbers, inputs, made, strict=True)}
        out = out.withColumns(bins).drop(*inputs, *made)
    flat = {f"{prefix}{f}": F.when(col(f).isNotNull(), 1).otherwise(0).cast("int") for f in cuts if not cuts[f]}
    names = {f"{prefix}{f}": F.coalesce(F.array_position(F.array(*map(F.lit, lv)), col(f)), F.lit(0)).cast("int") for f, lv in levels.items() if lv}
    return out.withColumns(flat | names) if flat or names else out


def _lookup(scores: list, bin_: Column, other: Column | None = None, width: int = 0) -> Column:
    if other is None:
        return F.element_at(F.array(*map(F.lit, scores)), bin_ + 1)
    cells = [v for row in scores for v in row]
    return F.element_at(F.array(*map(F.lit, cells)), bin_ * width + other + 1)


def term_scores(model: AdditiveModel, binned: DataFrame | None = None) -> list[list[Column]]:
    """Score columns by term and class over a frame with fine (b_) and coarse (p_) bins."""
    out = []
    for t in model.terms:
        if t.is_interaction:
            a, b = (F.col(f"`p_{f}`") for f in t.features)
            out.append([_lookup(s, a, b, len(s[0])) for s in t.scores])
        else:
            out.append([_lookup(s, F.col(f"`b_{t.features[0]}`")) for s in t.scores])
    return out


def with_bins(model: AdditiveModel, df: DataFrame) -> DataFrame:
    used = {f for t in model.terms if t.is_interaction for f in t.features}
    out = bin_frame(df, model.cuts, model.levels)
    if used:
        out = bin_frame(out, {f: c for f, c in model.coarse.items() if f in used}, {f: v for f, v in model.levels.items() if f in used}, "p_")
    return out


def numeric_cuts(df: DataFrame, features: list[str], max_bins: int) -> dict[str, list[float]]:
    """Inner bin edges from quantiles, one aggregation for all features; a feature with
    few values gets an edge at each."""
    if not features:
        return {}
    shares = [i / (max_bins - 1) for i in range(1, max_bins - 1)] or [0.5]
    row = df.agg(*(F.struct(F.percentile_approx(col(f), shares, 10_000).alias("q"), F.min(col(f)).alias("lo"), F.max(col(f)).alias("hi")).alias(f"q{i}") for i, f in enumerate(features))).first()
    out = {}
    for i, f in enumerate(features):
        q, lo, hi = row[f"q{i}"]
        if lo is None or lo == hi:
            out[f] = []
            continue
        points = sorted({lo, hi, *q})
        edges = [(a + b) / 2 for a, b in zip(points, points[1:], strict=False)]
        out[f] = edges[: max_bins - 1]
    return out


# --- the kernel: one bag, numpy -------------------------------------------------------


def _leaf(g: np.ndarray, h: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) / np.maximum(h + lam, 1e-12)


def _grow(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: dict, ordered: bool) -> tuple[np.ndarray, float]:
    """Values by bin of a tree of ``max_leaves`` leaves over one histogram, and its gain."""
    order = np.arange(len(g)) if ordered else np.argsort(g / np.maximum(h, 1e-12), kind="stable")
    G, H, N = (np.concatenate([[0], np.cumsum(v[order])]) for v in (g, h, n))
    alpha, lam, least = p["reg_alpha"], p["reg_lambda"], p["min_samples_leaf"]

    def worth(a, b):
        s = G[b] - G[a]
        return np.maximum(np.abs(s) - alpha, 0) ** 2 / np.maximum(H[b] - H[a] + lam, 1e-12)

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        cut = cut[(N[cut] - N[a] >= least) & (N[b] - N[cut] >= least)]
        if not len(cut):
            return 0.0, -1
        gain = worth(a, cut) + worth(cut, b) - worth(a, b)
        i = int(gain.argmax())
        return float(gain[i]), int(cut[i])

    leaves, total = [(0, len(g))], 0.0
    while len(leaves) < p["max_leaves"]:
        gain, cut, leaf = max(((*best(*x), x) for x in leaves), key=lambda t: t[0])
        if cut < 0 or gain <= 0:
            break
        total += gain
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[order[a:b]] = _leaf(G[b] - G[a], H[b] - H[a], alpha, lam) if len(leaves) > 1 else 0.0
    return out, total


def _gradients(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and curvatures by class of log loss."""
    if f.shape[1] == 1:
        q = 1 / (1 + np.exp(-np.clip(f[:, 0], -500, 500)))
        return (y - q)[:, None], (q * (1 - q))[:, None]
    z = np.exp(f - f.max(1, keepdims=True))
    q = z / z.sum(1, keepdims=True)
    return np.eye(f.shape[1])[y] - q, q * (1 - q)


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    if f.shape[1] == 1:
        z = f[:, 0] * np.where(y == 1, 1, -1)
        return float(np.logaddexp(0, -z).mean())
    return float((np.logaddexp.reduce(f, axis=1) - f[np.arange(len(y)), y]).mean())


def boost(bins: list[np.ndarray], sizes: list[int], ordered: list[bool], y: np.ndarray, f: np.ndarray, p: dict, seed: list[int]) -> list[np.ndarray]:
    """Cyclic boosting of the given bin columns from scores ``f``; the tables (bins, classes)
    of the round with the best validation loss."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < p["validation_size"]
    if held.all() or not held.any():
        held[:] = False
        held[: max(1, len(y) // 8)] = True
    yt, yv, ft, fv = y[~held], y[held], f[~held].copy(), f[held].copy()
    bt, bv = [b[~held] for b in bins], [b[held] for b in bins]
    tables = [np.zeros((s, f.shape[1])) for s in sizes]
    counts = [np.bincount(b, minlength=s) for b, s in zip(bt, sizes, strict=True)]
    best, best_loss, since = [t.copy() for t in tables], _loss(fv, yv), 0
    n_greedy = int(round(p["greedy_ratio"] * len(bins)))

    def step(i: int, rate: float, extra: dict) -> float:
        g, h = _gradients(ft, yt)
        gain = 0.0
        for k in range(f.shape[1]):
            if p["inner_bags"]:
                value = np.zeros(sizes[i])
                for _ in range(p["inner_bags"]):
                    w = rng.poisson(1.0, len(yt))
                    v, more = _grow(*(np.bincount(bt[i], x * w, sizes[i]) for x in (g[:, k], h[:, k])), np.bincount(bt[i], w, sizes[i]), p | extra, ordered[i])
                    value, gain = value + v / p["inner_bags"], gain + more
            else:
                value, more = _grow(np.bincount(bt[i], g[:, k], sizes[i]), np.bincount(bt[i], h[:, k], sizes[i]), counts[i], p | extra, ordered[i])
                gain += more
            tables[i][:, k] += rate * value
            ft[:, k] += rate * value[bt[i]]
            fv[:, k] += rate * value[bv[i]]
        return gain

    for r in range(p["max_rounds"]):
        smooth = {"reg_lambda": p["reg_lambda"] + 10.0} if r < p["smoothing_rounds"] else {}
        gains = [step(i, p["learning_rate"], smooth) for i in range(len(bins))]
        for _ in range(n_greedy):
            i = int(np.argmax(gains))
            gains[i] = step(i, p["learning_rate"], smooth)
        loss = _loss(fv, yv)
        if loss < best_loss - 1e-7:
            best, best_loss, since = [t.copy() for t in tables], loss, 0
        else:
            since += 1
            if p["early_stopping_rounds"] and since >= p["early_stopping_rounds"]:
                break
    return best if p["early_stopping_rounds"] else tables


def _bagged(binned: DataFrame, bags: int, seed: int, n: int, bag_rows: int) -> DataFrame:
    """Each bag's rows: all of them, or a share by hash that keeps about ``bag_rows``.

    Equal rows are told apart by their number among each other, so every combination
    keeps its share in a bag."""
    out = binned
    if n > bag_rows:
        out = numbered(binned)
    out = out.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    if n > bag_rows:
        share = int(bag_rows / n * 1_000_000)
        out = out.filter(F.pmod(F.xxhash64(*binned.columns, "_nth", "bag", F.lit(seed)), F.lit(1_000_000)) < share)
    return out.select(*binned.columns, "bag")


def fit(df: DataFrame, classes: list, *, continuous: list[str], nominal: dict[str, list[str]], params: dict, y: str = "y", bag_rows: int = BAG_ROWS) -> AdditiveModel:
    """Train on a frame of preprocessed features and the class code ``y``."""
    prior = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    n, k = sum(prior.values()), len(classes)
    shares = np.array([prior.get(i, 0) / n for i in range(k)])
    one = k == 2
    intercept = [float(np.log(shares[1] / shares[0]))] if one else list(map(float, np.log(np.maximum(shares, 1e-12))))
    cuts = numeric_cuts(df, continuous, params["max_bins"])
    coarse = numeric_cuts(df, continuous, params["max_interaction_bins"])
    model = AdditiveModel(classes, intercept, cuts, coarse, dict(nominal))
    features = model.features
    sizes = {f: len(c) + 2 for f, c in cuts.items()} | {f: len(v) + 1 for f, v in nominal.items()}
    ends = df.agg(*(F.struct(F.min(col(f)), F.max(col(f))).alias(f"e{i}") for i, f in enumerate(continuous))).first() if continuous else []
    model.ranges = {f: list(ends[f"e{i}"]) for i, f in enumerate(continuous) if ends[f"e{i}"][0] is not None}
    binned = bin_frame(df, cuts, nominal)
    fine = binned.select(F.col(y).alias("y"), *(F.col(f"`b_{f}`").cast("smallint").alias(f"b{i}") for i, f in enumerate(features)))
    schema = "term int, cls int, bin int, score double, weight double"
    seed = params["random_state"]
    ordered = [f in cuts for f in features]
    width = [sizes[f] for f in features]

    def mains(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in pdf.columns if c != "bag"], kind="stable")
        f = np.tile(np.array(intercept), (len(pdf), 1))
        bins = [pdf[f"b{i}"].to_numpy(dtype=np.int64) for i in range(len(width))]
        tables = boost(bins, width, ordered, pdf["y"].to_numpy(dtype=np.int64), f, params, [seed, int(pdf["bag"].iloc[0])])
        return _long(tables, bins)

    bags = params["outer_bags"]
    rows = _bagged(fine, bags, seed, n, bag_rows).groupBy("bag").applyInPandas(mains, schema)
    averaged = rows.groupBy("term", "cls", "bin").agg(F.avg("score").alias("score")).collect()
    weights = _bin_weights(binned, features, sizes)
    tables = [np.zeros((w, len(intercept))) for w in width]
    for r in averaged:
        tables[r["term"]][r["bin"], r["cls"]] = r["score"]
    for f, t in zip(features, tables, strict=True):
        w = weights[f]
        t[w == 0] = 0.0
        mean = (t * w[:, None]).sum(0) / w.sum()
        t[w > 0] -= mean
        model.intercept = [a + float(b) for a, b in zip(model.intercept, mean, strict=True)]
        model.terms.append(Term([f], t.T.tolist(), float((np.abs(t).mean(1) * w).sum() / w.sum())))
    pairs = list(itertools.combinations(features, 2))
    if params["interactions"] and pairs:
        _add_pairs(model, df, y, params, pairs, n, bag_rows)
    return model


def _long(tables: list[np.ndarray], bins: list[np.ndarray]) -> pd.DataFrame:
    out = []
    for t, table in enumerate(tables):
        w = np.bincount(bins[t], minlength=len(table))
        for c in range(table.shape[1]):
            out.append(pd.DataFrame({"term": t, "cls": c, "bin": np.arange(len(table)), "score": table[:, c], "weight": w.astype(float)}))
    return pd.concat(out)


def _bin_weights(binned: DataFrame, features: list[str], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Training rows by bin, for all features in one aggregation."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`b_{f}`").alias("b")) for i, f in enumerate(features)))
    rows = binned.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.b").count().collect()
    out = {f: np.zeros(sizes[f]) for f in features}
    for i, b, n in rows:
        out[features[i]][b] = n
    return out


def _raw_scores(model: AdditiveModel) -> list[Column]:
    by_term = term_scores(model)
    out = []
    for c, base in enumerate(model.intercept):
        total = F.lit(base)
        for s in by_term:
            total = total + s[c]
        out.append(total)
    return out


def pair_gains(df: DataFrame, pairs: list[tuple[str, str]], g: list[Column], h: list[Column]) -> DataFrame:
    """(pair, a, b, g0, h0, ...): residual sums by cell of every pair's coarse table, one
    combining aggregation over all pairs."""
    cells = F.array(*(F.struct(F.lit(i).alias("pair"), F.col(f"`p_{a}`").alias("a"), F.col(f"`p_{b}`").alias("b")) for i, (a, b) in enumerate(pairs)))
    sums = [c.alias(f"g{i}") for i, c in enumerate(g)] + [c.alias(f"h{i}") for i, c in enumerate(h)]
    long = df.select(F.explode(cells).alias("c"), *sums).select("c.*", *(f"{x}{i}" for x in "gh" for i in range(len(g))))
    return long.groupBy("pair", "a", "b").agg(*(F.sum(f"{x}{i}").alias(f"{x}{i}") for x in "gh" for i in range(len(g))), F.count(F.lit(1)).alias("n"))


def _add_pairs(model: AdditiveModel, df: DataFrame, y: str, params: dict, pairs: list[tuple[str, str]], n: int, bag_rows: int) -> None:
    binned = bin_frame(with_bins(model, df), model.coarse, model.levels, "p_")
    raw = _raw_scores(model)
    if model.n_scores == 1:
        q = 1 / (1 + F.exp(-raw[0]))
        g, h = [F.col(y) - q], [q * (1 - q)]
    else:
        top = F.greatest(*raw)
        z = [F.exp(r - top) for r in raw]
        whole = sum(z[1:], z[0])
        q = [v / whole for v in z]
        g, h = [(F.col(y) == i).cast("double") - p for i, p in enumerate(q)], [p * (1 - p) for p in q]
    table = pair_gains(binned, pairs, g, h).toPandas()
    ks = range(model.n_scores)

    def gain(t: pd.DataFrame) -> float:
        """Gain of the best 2 x 2 cut over that of the margins' independent effects."""
        size = (t["a"].max() + 1, t["b"].max() + 1)
        best = 0.0
        G, H = np.zeros((*size, len(ks))), np.zeros((*size, len(ks)))
        for k in ks:
            G[t["a"], t["b"], k], H[t["a"], t["b"], k] = t[f"g{k}"], t[f"h{k}"]
        cg, ch = G.cumsum(0).cumsum(1), H.cumsum(0).cumsum(1)
        for i in range(size[0] - 1):
            q1g, q1h = cg[i, :-1], ch[i, :-1]
            rg, rh = cg[i, -1], ch[i, -1]
            q2g, q2h = rg - q1g, rh - q1h
            q3g, q3h = cg[-1, :-1] - q1g, ch[-1, :-1] - q1h
            q4g, q4h = cg[-1, -1] - rg - q3g, ch[-1, -1] - rh - q3h
            score = sum((a * a / np.maximum(b, 1e-9)).sum(-1) for a, b in ((q1g, q1h), (q2g, q2h), (q3g, q3h), (q4g, q4h)))
            if len(score):
                best = max(best, float(score.max()))
        return best

    ranked = sorted(((gain(t), -i) for i, t in table.groupby("pair")), reverse=True)
    chosen = [pairs[-i] for _, i in ranked[: params["interactions"]]]
    width = {f: len(model.coarse[f]) + 2 if f in model.coarse else len(model.levels[f]) + 1 for f in model.features}
    shape = [(width[a], width[b]) for a, b in chosen]
    flat = [(F.col(f"`p_{a}`") * width[b] + F.col(f"`p_{b}`")).cast("int").alias(f"b{i}") for i, (a, b) in enumerate(chosen)]
    rows = binned.select(F.col(y).alias("y"), *flat, *(r.alias(f"f{c}") for c, r in enumerate(raw)))
    seed, names = params["random_state"], [f"b{i}" for i in range(len(chosen))]

    def boost_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*names, "y"], kind="stable")
        bins = [pdf[c].to_numpy(dtype=np.int64) for c in names]
        f = pdf[[f"f{c}" for c in range(model.n_scores)]].to_numpy()
        tables = boost(bins, [a * b for a, b in shape], [False] * len(bins), pdf["y"].to_numpy(dtype=np.int64), f, params, [seed, 1 + int(pdf["bag"].iloc[0])])
        return _long(tables, bins)

    got = _bagged(rows, params["outer_bags"], seed + 1, n, bag_rows).groupBy("bag").applyInPandas(boost_pairs, "term int, cls int, bin int, score double, weight double")
    mean = got.groupBy("term", "cls", "bin").agg(F.avg("score").alias("score"), F.avg("weight").alias("weight")).collect()
    tables = [np.zeros((a * b, model.n_scores)) for a, b in shape]
    weights = [np.zeros(a * b) for a, b in shape]
    for r in mean:
        tables[r["term"]][r["bin"], r["cls"]] = r["score"]
        weights[r["term"]][r["bin"]] = r["weight"]
    for i, ((a, b), t, w) in enumerate(zip(chosen, tables, weights, strict=True)):
        t[w == 0] = 0.0
        centre = (t * w[:, None]).sum(0) / max(w.sum(), 1e-12)
        t[w > 0] -= centre
        model.intercept = [x + float(v) for x, v in zip(model.intercept, centre, strict=True)]
        importance = float((np.abs(t).mean(1) * w).sum() / max(w.sum(), 1e-12))
        model.terms.append(Term([a, b], [t[:, k].reshape(shape[i]).tolist() for k in ks], importance))
