"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Small trees are grown on statistics of labelled texts; every path from a root
to a node, as a conjunction of thresholds, is a candidate rule. Logistic
regression with a lasso penalty (proximal gradient steps) picks the rules that
stay. The result is one Spark expression: the logistic function of the sum of
the weights of the rules that a row meets. Scoring needs no Python and no
broadcast; statistics come from DataFrame functions over whole texts.

Trees and weights are fitted on a bounded sample of labelled rows (SAMPLE rows
in the registered queries), of which the driver gets the statistics only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqltext import count_of, let, word_lines, words

#: Statistics, as SQL over t (text), ws (words), ls (lines with a word), n (characters) and m (words).
STATISTICS = {
    "n_words": "cast(m as double)",
    "mean_word": "length(concat_ws('', ws)) / greatest(m, 1)",
    "distinct_share": "size(array_distinct(ws)) / greatest(m, 1)",
    "symbol_share": f"{count_of('t', '#*$%&|<>=~^@+{}')} / greatest(n, 1)",
    "capital_share": f"{count_of('t', 'A-Z')} / greatest(n, 1)",
    "digit_share": f"{count_of('t', '0-9')} / greatest(n, 1)",
    "exclaim_share": f"{count_of('t', '!?')} / greatest(m, 1)",
    "stop_share": f"{count_of('t', '.,;:')} / greatest(m, 1)",
    "repeat_lines": "(size(ls) - size(array_distinct(ls))) / greatest(size(ls), 1)",
    "words_a_line": "m / greatest(size(ls), 1)",
}


def statistics_expr(text_col: str) -> str:
    """SQL for a struct of STATISTICS of a text; null counts as empty."""
    fields = ", ".join(f"'{k}', cast({v} as double)" for k, v in STATISTICS.items())
    body = let("ls", word_lines("t"), let("n", "length(t)", let("m", "size(ws)", f"named_struct({fields})")))
    return let("t", f"coalesce(`{text_col}`, '')", let("ws", words("t"), body))


#: Labelled rows that the registered queries fit on.
SAMPLE = 4000


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold); above: >, else <=."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, at in self.terms:
            out &= (x[:, f] > at) if above else (x[:, f] <= at)
        return out


@dataclass
class Model:
    names: tuple[str, ...]
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, stats_col: str) -> Column:
        """The score of a row that has the statistics as struct stats_col."""
        total: Column = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            met: Column = F.lit(True)
            for f, above, at in rule.terms:
                value = F.col(f"{stats_col}.{self.names[f]}")
                met = met & ((value > F.lit(float(at))) if above else (value <= F.lit(float(at))))
            total = total + F.when(met, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            total += w * rule.holds(x)
        return 1.0 / (1.0 + np.exp(-total))


def _best_split(x: np.ndarray, r: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(gain, statistic, threshold) that most lowers the squared error of r."""
    best = None
    whole = r.sum() ** 2 / len(r)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(r[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(r) - least)]
        if not len(at):
            continue
        left = s[at - 1]
        gain = left**2 / at + (s[-1] - left) ** 2 / (len(r) - at) - whole
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    return best if best and best[0] > 1e-9 else None


def _grow(x: np.ndarray, r: np.ndarray, rng: np.random.Generator, depth: int, least: int, terms: tuple = ()) -> list[tuple]:
    """Paths from the root to each other node of a tree."""
    if depth == 0 or len(r) < 2 * least:
        return []
    features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
    split = _best_split(x, r, features, least)
    if split is None:
        return []
    _, f, at = split
    out = []
    for above in (False, True):
        rows = (x[:, f] > at) if above else (x[:, f] <= at)
        path = (*terms, (f, above, at))
        out.append(path)
        out += _grow(x[rows], r[rows], rng, depth - 1, least, path)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    """Distinct rules of all paths of trees grown on random halves, each on what the trees before it leave."""
    rng = np.random.default_rng(seed)
    total = np.full(len(y), y.mean())
    rules: dict[tuple, None] = {}
    least = max(3, len(y) // 400)
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        if some.sum() < 2 * least:
            some[:] = True
        paths = _grow(x[some], (y - total)[some], rng, depth, least)
        for path in paths:
            rules.setdefault(tuple(sorted(path)), None)
        ends = [p for p in paths if not any(q != p and q[: len(p)] == p for q in paths)]
        for p in ends:
            at = Rule(p).holds(x)
            if (at & some).any():
                total[at] += 0.3 * (y - total)[at & some].mean()
    return [Rule(p) for p in rules]


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression with penalty * sum of absolute weights, by accelerated proximal gradients."""
    n = len(y)
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 * n / (np.linalg.norm(x, 2) ** 2 + n)
    for _ in range(steps):
        g = 1.0 / (1.0 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new = v - rate * (x.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0.0)
        new_b = c - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        if np.abs(new - w).max(initial=0.0) < 1e-7 and abs(new_b - b) < 1e-7:
            w, b = new, new_b
            break
        w, b, t = new, new_b, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005) -> Model:
    """A model of rows of statistics x and labels y (0 or 1); with one label only, that label's constant."""
    names = tuple(STATISTICS)
    if len(y) == 0:
        return Model(names, [], [], 0.0)
    rules = extract_rules(x, y) if 0 < y.sum() < len(y) else []
    if not rules:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model(names, [], [], float(np.log(share / (1 - share))))
    on = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    on, first = np.unique(on, axis=1, return_index=True)
    w, b = lasso_logistic(on, y.astype(float), penalty)
    keep = np.flatnonzero(w)
    return Model(names, [rules[first[k]] for k in keep], [float(w[k]) for k in keep], float(b))


def with_statistics(df: DataFrame, text_col: str = "text", stats_col: str = "__quality") -> DataFrame:
    return df.withColumn(stats_col, F.expr(statistics_expr(text_col)))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """A model of labelled rows; the driver gets the statistics of each, so give a bounded sample (see common.labelled_sample).

    Rows without label or id are left out.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    got = sorted(with_statistics(rows, "t").select("i", "y", "__quality.*").collect())
    x = np.array([[r[k] for k in STATISTICS] for r in got], dtype=float).reshape(len(got), len(STATISTICS))
    return fit_rules(x, np.array([r["y"] for r in got], dtype=int))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col, the probability of label 1 (empty and null texts too); replaces a column of that name."""
    return with_statistics(df, text_col).withColumn(score_col, model.column("__quality")).drop("__quality")
