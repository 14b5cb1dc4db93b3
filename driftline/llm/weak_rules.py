"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the
counts of vote patterns (all rows; at most 3 ** rules patterns, whatever the
corpus) estimates how often each rule votes each way on good and on bad
documents, and the share of good ones. The posterior probability of a
document then is a sum of logarithms over its votes, compiled to one column
expression; a document is kept when it reaches 0.5. No rule rejects alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sqltext import BLANKS, count_of, let, lit, word_lines, words, words_in_repeats

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
NOT_LETTERS = r"^\p{L}"
MIN_WORDS = 50
REPEAT_WORDS = 3


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the statistics; a row that meets neither abstains."""

    name: str
    good: str
    bad: str


#: Each rule looks at something of its own, as the model takes votes for independent given the class: symbols in any place are one rule, repetition in any form is one.
RULES = (
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "n_symbols * 50 <= n_words and n_symbol_ends * 50 <= n_words", "n_symbols * 10 > n_words or n_symbol_ends * 10 > n_words"),
    Rule("letters", "n_other * 12 <= word_chars", "n_other * 10 > word_chars"),
    Rule(
        "repetition",
        "n_dup_lines * 10 <= n_lines and n_repeat_words * 10 <= n_words and (n_distinct * 2 >= n_words or n_distinct > 300)",
        "n_dup_lines * 10 > 3 * n_lines or n_repeat_words * 10 > 3 * n_words or (n_distinct * 10 < 2 * n_words and n_distinct < 100)",
    ),
    Rule("capitals", "n_upper * 10 <= word_chars", "n_upper * 10 > 3 * word_chars"),
    Rule("exclamations", "n_exclaims * 50 <= n_words", "n_exclaims * 10 > n_words"),
    Rule("sentence_ends", "n_stops * 60 >= n_words", "n_stops * 400 < n_words"),
)


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts that the rules read; a null text counts as empty."""
    t = f"coalesce(`{text_col}`, '')"
    stats = let(
        "t",
        t,
        let(
            "ws",
            words("t"),
            let(
                "ls",
                word_lines("t"),
                "named_struct("
                "'n_words', cast(size(ws) as bigint), "
                "'word_chars', cast(length(concat_ws('', ws)) as bigint), "
                f"'n_symbols', cast({count_of('t', SYMBOLS)} as bigint), "
                "'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint), "
                f"'n_repeat_words', {words_in_repeats('ws', REPEAT_WORDS)}, "
                "'n_lines', cast(size(ls) as bigint), "
                f"'n_upper', cast({count_of('t', 'A-Z')} as bigint), "
                f"'n_other', cast({count_of('t', NOT_LETTERS)} - {count_of('t', BLANKS)} as bigint), "
                f"'n_symbol_ends', cast(size(regexp_extract_all(t, {lit(f'[{SYMBOLS}](?=[{BLANKS}]|$)')}, 0)) as bigint), "
                f"'n_exclaims', cast({count_of('t', '!')} as bigint), "
                f"'n_stops', cast({count_of('t', '.?')} as bigint), "
                "'n_distinct', cast(size(array_distinct(ws)) as bigint))",
            ),
        ),
    )
    return df.withColumn("__stats", F.expr(stats))


def vote_expr(rule: Rule) -> str:
    """1 good, 0 bad, 2 abstains."""
    return f"case when {rule.bad} then 0 when {rule.good} then 1 else 2 end"


@dataclass
class LabelModel:
    prior: float
    #: chance[c][r][v]: how often rule r votes v on documents of class c (0 bad, 1 good)
    chance: np.ndarray

    def log_odds(self) -> np.ndarray:
        """Rows of rules, columns of votes."""
        return np.log(self.chance[1]) - np.log(self.chance[0])


#: What is assumed of a rule before any data: how often it votes bad on good and on bad documents, and how many rows of each class that is worth.
BAD_ON_GOOD, BAD_ON_BAD, PRIOR_ROWS = 0.02, 0.4, 100.0


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """EM over vote patterns (rows of votes 0, 1, 2) and how often each occurs.

    The assumptions above are the start, and count as PRIOR_ROWS rows of each
    class however many rows there are.
    """
    one_hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    total = max(counts.sum(), 1.0)
    abstain = np.clip((one_hot[:, :, 2] * counts[:, None]).sum(axis=0) / total, 0.001, 0.98)
    start = np.stack([np.stack([(1 - abstain) * q, (1 - abstain) * (1 - q), abstain], axis=1) for q in (BAD_ON_BAD, BAD_ON_GOOD)])
    chance, prior = start, 0.8
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", one_hot, np.log(chance)) + np.log([1 - prior, prior])
        post = 1.0 / (1.0 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        weight = np.stack([(1 - post) * counts, post * counts])
        new = np.einsum("cp,prv->crv", weight, one_hot) + start * PRIOR_ROWS
        new /= new.sum(axis=2, keepdims=True)
        new_prior = float(np.clip(weight[1].sum() / total, 0.02, 0.98))
        done = abs(new_prior - prior) < 1e-9 and np.abs(new - chance).max() < 1e-9
        chance, prior = new, new_prior
        if done:
            break
    return LabelModel(prior, chance)


def learn(stats: DataFrame) -> LabelModel:
    """The model of all rows of a frame with the statistics as columns."""
    votes = stats.select(*(F.expr(vote_expr(r)).alias(r.name) for r in RULES))
    seen = votes.groupBy(*(r.name for r in RULES)).agg(F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        return LabelModel(0.5, np.full((2, len(RULES), 3), 1 / 3))
    return fit(np.array([[row[r.name] for r in RULES] for row in seen]), np.array([row["n"] for row in seen], dtype=float))


def posterior_expr(model: LabelModel) -> str:
    """SQL for the probability that a document is good, from the statistics."""
    odds = model.log_odds()
    terms = [f"(case when {r.bad} then {bad!r}D when {r.good} then {good!r}D else {none!r}D end)" for r, (bad, good, none) in zip(RULES, odds.tolist())]
    start = float(np.log(model.prior) - np.log(1 - model.prior))
    return f"1D / (1D + exp(-({start!r}D + {' + '.join(terms)})))"


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, posterior.

    base_failed: under 50 words, or more than half of the words lie in 3-word
    windows that occur twice or more. kept: not base_failed and a posterior of
    0.5 or more. A null or empty text has no words and fails. Only id and text
    are read; ids may be null or repeat.
    """
    stats = statistics(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "__stats.*")
    stats = common.stored(stats, "statistics")
    model = learn(stats)
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")
    out = stats.withColumn("base_failed", failed).withColumn("posterior", F.expr(posterior_expr(model)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
