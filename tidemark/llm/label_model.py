"""Generative label models over vote patterns.

Votes are -1, 0 (abstain) or 1. Spark counts the distinct vote patterns of all rows; with m voters there are at most
3**m patterns, so what reaches the driver is bounded by the voters and never by the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VOTERS = 12


@dataclass
class LabelModel:
    """log P(vote | class) for each voter, and the prior of class 1."""

    names: list[str]
    weight: np.ndarray  # of each voter: below 1 where it repeats what others say
    table: np.ndarray  # voters x 3 votes (-1, 0, 1) x 2 classes, probabilities
    prior: float
    correlation: np.ndarray

    def odds(self) -> np.ndarray:
        """Voters x 3: what each vote adds to the log odds of class 1."""
        return self.weight[:, None] * (np.log(self.table[:, :, 1]) - np.log(self.table[:, :, 0]))

    def posterior(self, votes: dict[str, Column]) -> Column:
        total = F.lit(float(np.log(self.prior) - np.log1p(-self.prior)))
        for name, row in zip(self.names, self.odds(), strict=True):
            v = votes[name]
            total = total + F.when(v < 0, float(row[0])).when(v > 0, float(row[2])).otherwise(float(row[1]))
        return 1.0 / (1.0 + F.exp(-total))

    def posterior_array(self, votes: np.ndarray) -> np.ndarray:
        odds = self.odds()[np.arange(votes.shape[1])[None, :], votes + 1].sum(1) + np.log(self.prior) - np.log1p(-self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """P(vote agrees with the class | it votes)."""
        p = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, 0] * p[0] + self.table[:, 2, 1] * p[1]
        wrong = self.table[:, 2, 0] * p[0] + self.table[:, 0, 1] * p[1]
        return dict(zip(self.names, (right / np.maximum(right + wrong, 1e-12)).tolist(), strict=True))


def patterns(df: DataFrame, names: list[str], n: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns and their counts (of rows, or of ``n``), summed before the shuffle."""
    if len(names) > MOST_VOTERS:
        raise ValueError(f"at most {MOST_VOTERS} voters, so that patterns stay few")
    got = df.groupBy(*[F.col(n).cast("int").alias(n) for n in names]).agg((F.sum(n) if n else F.count(F.lit(1))).alias("_n")).collect()
    got = sorted(got)
    return np.array([[r[n] or 0 for n in names] for r in got], int).reshape(len(got), len(names)), np.array([r["_n"] for r in got], float)


def fit(votes: np.ndarray, counts: np.ndarray, names: list[str], start: np.ndarray | None = None, rounds: int = 100, smooth: float = 2.0, with_correlations: bool = False, anchor: float = 20.0) -> LabelModel:
    """Expectation-maximisation. start: first posteriors by pattern, else the share of votes for class 1.

    ``anchor`` pseudo-counts hold each voter to better than chance, so that the classes can't change places.
    Correlations: covariance of two voters within a class, beyond what the class explains; a voter's weight is
    one over one plus its positive correlations, so a cluster of voters that repeat each other counts as about one.
    """
    m = votes.shape[1]
    if not len(votes):
        return LabelModel(names, np.ones(m), np.full((m, 3, 2), 1 / 3), 0.5, np.eye(m))
    hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    base = np.zeros((m, 3, 2))
    base[:, 0, 0] = base[:, 2, 1] = anchor
    base[:, 1, :] = base[:, 0, 1:] = smooth
    base[:, 2, 0] = smooth
    q = start if start is not None else (1 + (votes > 0).sum(1)) / (2 + (votes != 0).sum(1))
    weight, rho = np.ones(m), np.eye(m)
    for turn in range(2 if with_correlations else 1):
        for _ in range(rounds):
            table = base + np.stack([np.einsum("pmk,p->mk", hot, counts * (1 - q)), np.einsum("pmk,p->mk", hot, counts * q)], 2)
            table /= table.sum(1, keepdims=True)
            prior = float(np.clip((counts @ q + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
            model = LabelModel(names, weight, table, prior, rho)
            new = model.posterior_array(votes)
            moved, q = np.abs(new - q).max(), new
            if moved < 1e-7:
                break
        if with_correlations and not turn:
            cov, var = np.zeros((m, m)), np.zeros(m)
            for share in (counts * (1 - q), counts * q):
                total = max(share.sum(), 1e-9)
                x = votes - (share @ votes) / total
                cov += (x * share[:, None]).T @ x
                var += share @ (x * x)
            rho = cov / np.sqrt(np.maximum(np.outer(var, var), 1e-12))
            weight = 1 / (1 + np.clip(rho - np.eye(m), 0, 1).sum(1))
    return LabelModel(names, weight, table, prior, rho)
