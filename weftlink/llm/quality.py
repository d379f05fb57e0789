"""Quality classifier: a sparse ensemble of rules over text statistics (Friedman and Popescu, 2008).

1. Statistics of each whole text are Spark expressions.
2. On a bounded sample of labelled rows, small boosted trees are grown; the path to each of their nodes is
   a rule, a conjunction of comparisons.
3. Lasso logistic regression over the rules keeps few of them and gives their weights.
4. The kept rules are compiled into one Spark column expression, so scoring needs no Python and no shuffle.

Defined cases: a null text is an empty one and gets a score like any other; the statistics are of whole texts, however long; repeated
rows and null ids keep their rows; a null label or id is not learnt from, an id with several labels has its smallest, and one with several texts is learnt from
by the text of the smallest statistics; without
labels of both kinds the score is the same for every text: the share of label 1, 0.5 without any; extra columns
are ignored by ``score_quality`` and kept by ``quality_score``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import texts
from weftlink.llm.trees import Binned


@dataclass(frozen=True)
class QualityParams:
    labelled: int = 20_000  #: labelled rows that the model is fitted on at most (smallest hashes of their ids)
    trees: int = 60
    depth: int = 3
    least: int = 10  #: rows in a leaf at least
    share: float = 0.6  #: rows that each tree sees
    rate: float = 0.15
    penalty: float = 0.002  #: of the lasso
    rounds: int = 400
    threshold: float = 0.3
    seed: int = 8


def _statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")
    count = lambda s: (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).cast("double")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    plain = only(r"\p{L}\p{N}\s.,;:!?'\"()\-")
    return {
        "chars": F.length(text).cast("double"),
        "upper_share": only(r"\p{Lu}") / chars,
        "digit_share": only(r"0-9") / chars,
        "symbol_share": 1.0 - plain / chars,
        "bang_share": count("!") / chars,
        "bar_share": count("|") / chars,
        "stop_share": count(".") / chars,
        "comma_share": count(",") / chars,
        "word_length": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "line_length": chars / n_lines,
        "repeated_lines": 1.0 - F.size(F.array_distinct(lines)) / n_lines,
    }


STATISTICS = ("chars", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "stop_share", "comma_share", "word_length", "distinct_words", "line_length", "repeated_lines")


def statistics(text: Column) -> Column:
    """What the rules are about, as a struct: shares and means that don't depend on a language's words.

    Words and lines are split once, and bound to a lambda's variable for all statistics that need them.
    """
    parts = F.struct(text.alias("text"), F.split(text, r"[ \n\t\r]+").alias("words"), F.split(text, "\n").alias("lines"))
    named = lambda x: F.struct(*[c.alias(n) for n, c in _statistics(x["text"], x["words"], x["lines"]).items()])
    return F.transform(F.array(parts), named)[0]


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    intercept: float
    rules: tuple[tuple[float, Rule], ...]  #: weight and conditions

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            test = F.lit(True)
            for f, at_most, t in rule:
                x = stats[self.names[f]]
                test = test & ((x <= F.lit(t)) if at_most else (x > F.lit(t)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        say = lambda r: " and ".join(f"{self.names[f]} {'<=' if m else '>'} {t:.6g}" for f, m, t in r)
        return [f"{w:+.3f} if {say(r)}" for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, at_most, t in rule:
        ok &= x[:, f] <= t if at_most else x[:, f] > t
    return ok


def _simplified(rule: Rule) -> Rule:
    """Of several bounds on one side of a feature only the tightest says anything."""
    tight: dict[tuple[int, bool], float] = {}
    for f, at_most, t in rule:
        tight[f, at_most] = (min if at_most else max)(tight.get((f, at_most), t), t)
    return tuple((f, m, t) for (f, m), t in sorted(tight.items()))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Lasso logistic regression by accelerated proximal gradient steps; columns count by their spread."""
    spread = np.maximum(x.std(0), 1e-6)
    z = (x - x.mean(0)) / spread
    n = len(y)
    step = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2 + n)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    k = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        nw = v - step * (z.T @ (p - y)) / n
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * penalty)
        nb = c - step * float((p - y).mean())
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, c = nw + (k - 1) / nk * (nw - w), nb + (k - 1) / nk * (nb - b)
        w, b, k = nw, nb, nk
    weights = w / spread
    return b - float((weights * x.mean(0)).sum()), weights


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], p: QualityParams) -> RuleModel:
    """Fit on statistics ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return RuleModel(names, 0.0, ())
    if y.min() == y.max():
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return RuleModel(names, float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(p.seed)
    binned = Binned(x)
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, np.ndarray] = {}
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        rows = np.sort(rng.permutation(len(y))[:max(2 * p.least, int(p.share * len(y)))])
        tree = binned.grow(y - prob, rows, rng, p.depth, p.least)
        total = total + p.rate * 4 * tree.predict(x)
        for path in tree.paths():
            rule = _simplified(path)
            if rule not in rules:
                hit = _holds(x, rule)
                if 0 < hit.sum() < len(y):
                    rules[rule] = hit
    distinct: dict[bytes, Rule] = {}
    for rule, hit in rules.items():
        distinct.setdefault(np.packbits(hit if hit[0] else ~hit).tobytes(), rule)
    kept = list(distinct.values())
    if not kept:
        return RuleModel(names, float(total[0]), ())
    intercept, weights = _lasso(np.column_stack([rules[r] for r in kept]).astype(np.float64), y, p.penalty, p.rounds)
    return RuleModel(names, intercept, tuple((float(w), r) for w, r in zip(weights, kept) if abs(w) > 1e-9))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on the labelled documents that aren't held out; their number is bounded by ``params.labelled``."""
    p = params
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.labelled)
    rows = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "y", statistics(F.col("text")).alias("s"))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("s").alias("s")).select("doc_id", "y", "s.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64), STATISTICS, p)


def quality_score(docs: DataFrame, model: RuleModel, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``name`` added: the score of each text.

    The statistics are bound to a lambda's variable, so a filter on the score that Spark moves below this projection
    takes them along once, not once for every comparison of a rule.
    """
    stats = statistics(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn(name, F.transform(F.array(stats), lambda x: model.column(x))[0])


def score_quality(docs: DataFrame, model: RuleModel, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = quality_score(texts(docs, id_col, text_col), model, "score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= params.threshold, 1).otherwise(0).cast("int").alias("predicted"))
