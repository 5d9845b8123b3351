"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives every document a probability of each domain. A document of n words
then brings `n * p_k` tokens to domain k, and rates 0 <= r <= `most` are wanted whose expected totals
`sum_d r_d n_d p_dk` match the targets: a least-squares problem with one unknown per document and one equation per domain.
It is solved by projected gradient steps: all rates start equal, a step adds to every rate the document's probabilities
times one multiplier per domain, taken from the residual and scaled by the inverse Gram matrix of the rows that can
still move, and the sum of the steps so far is projected to the bounds. A step is halved until it brings the residual down.
Each needs a handful of sums over the stored table of memberships, added up in the tasks; the rates never leave their
rows. A small pull to the first rates (`PULL`) makes the solution the one that changes rates least, and steps end at it.

Targets are the weights times the most tokens that the supplies allow at them with no rate above `most` (1: no document is
repeated), or a share of that on request: the scarcest domain, measured by its weight, gives all it has. Memberships may be
too soft to take that much of it and no more of the others; then the rates are those with the smallest residual. The steps
begin at the solution of a summary: sums of the memberships in at most `CELLS` cells of equal rounded probabilities.

A document is drawn `floor(rate)` times, and once more if a hash of its id falls below the rest, so the draw is the same in
every run.

Defined results: null and empty texts bring no tokens, take no part in the fit and keep the rate that their probabilities
give; weights are scaled to sum 1, and weights that are all zero leave every rate at the smaller of 1 and most; repeated
rows are rated one by one; labels that name no domain are not learned. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import quality_classifier
from kindred.runtime import stored

# Domains as the labelled table marks them, in the order of the classes.
DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.9, "poor": 0.03, "toxic": 0.07}


# Cells of the summary, and the pull to the first rates (a share of all tokens).
CELLS = 4096
PULL = 1e-6
# A step over all rows that brings what is left down by less than this share is the last.
STEP_GAIN = 0.02


@dataclass
class Settings:
    most: float = 1.0
    budget_share: float = 1.0  # of the tokens that the supplies allow at the weights
    steps: int = 20
    tolerance: float = 1e-6  # of the targets


@dataclass
class Fit:
    """Targets, expected totals, the first rate and the multipliers of the steps' sum."""

    targets: np.ndarray
    totals: np.ndarray
    first: float
    multipliers: np.ndarray


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and class of rows that name a domain: toxic before poor before good."""
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", label.alias("label"))


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _kd_tokens and _kd_chances (one probability per domain) beside their own columns."""
    model = quality_classifier.train(docs, domain_labels(labels), len(DOMAINS))
    spoken = F.coalesce(F.col("text"), F.lit(""))
    return quality_classifier.with_chances(docs, model).withColumn(
        "_kd_tokens", F.regexp_count(spoken, F.lit(r"[^\x20\x09-\x0D]+")).cast("double")
    )


def rate(first: float, multipliers: np.ndarray, most: float) -> Column:
    """The rate of a row: the first rate and the multipliers times the row's chances, within the bounds."""
    moved = sum((F.lit(float(m)) * F.col("_kd_chances")[k] for k, m in enumerate(multipliers)), F.lit(float(first)))
    return F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(most)))


def descend(
    sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    pull: float,
    start: np.ndarray,
    steps: int,
    tolerance: float,
    gain: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers at the end of the steps, and the totals there. sums gives the totals and the Gram matrix of the rows that
    can still move for some multipliers. The end is where the residual equals the pull to the first rates; a step
    that lowers what is left by less than the share `gain` is the last."""

    def left(multipliers: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return targets - totals - pull * multipliers

    at = start
    totals, gram = sums(at)
    for _ in range(steps):
        residual = left(at, totals)
        if np.abs(residual).max() <= tolerance * max(targets.sum(), 1e-12):
            break
        move, length, size = np.linalg.solve(gram + pull * np.eye(len(at)), residual), 1.0, np.linalg.norm(residual)
        while True:
            tried = at + length * move
            reached, reached_gram = sums(tried)
            now = np.linalg.norm(left(tried, reached))
            if now < size:
                at, totals, gram = tried, reached, reached_gram
                break
            length /= 4
            if length < gain:
                return at, totals
        if now > (1 - gain) * size:
            break
    return at, totals


def table_sums(members: DataFrame, count: int, first: float, most: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """sums of descend over all rows of members (_kd_tokens, _kd_chances): one job each."""
    tokens, chance = F.col("_kd_tokens"), [F.col("_kd_chances")[k] for k in range(count)]
    pairs = [(a, b) for a in range(count) for b in range(a, count)]

    def sums(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = members.select(tokens.alias("n"), F.array(*chance).alias("p"), rate(first, multipliers, most).alias("r"))
        free = F.when((F.col("r") > 0) & (F.col("r") < most), F.col("n")).otherwise(0.0)
        row = held.agg(
            *[F.sum(F.col("r") * F.col("n") * F.col("p")[k]).alias(f"s{k}") for k in range(count)],
            *[F.sum(free * F.col("p")[a] * F.col("p")[b]).alias(f"g{a}_{b}") for a, b in pairs],
        ).first()
        gram = np.zeros((count, count))
        for a, b in pairs:
            gram[a, b] = gram[b, a] = row[f"g{a}_{b}"] or 0.0
        return np.array([row[f"s{k}"] or 0.0 for k in range(count)]), gram

    return sums


def cell_sums(tokens: np.ndarray, chances: np.ndarray, first: float, most: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The same over the cells of the summary, given their tokens and mean chances."""

    def sums(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rates = np.clip(first + chances @ multipliers, 0, most)
        free = tokens * ((rates > 0) & (rates < most))
        return (rates * tokens) @ chances, (chances * free[:, None]).T @ chances

    return sums


def summary(members: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean chances of the cells of equal rounded chances; at most about CELLS rows."""
    levels = max(1, int(CELLS ** (1 / max(count - 1, 1))))
    rounded = [F.least(F.floor(F.col("_kd_chances")[k] * levels), F.lit(levels - 1)).alias(f"c{k}") for k in range(count - 1)]
    tokens = F.col("_kd_tokens")
    rows = (
        members.filter(tokens > 0)
        .groupBy(*rounded)
        .agg(F.sum(tokens).alias("n"), *[F.sum(tokens * F.col("_kd_chances")[k]).alias(f"s{k}") for k in range(count)])
        .collect()
    )
    held = np.array([r["n"] for r in rows], float)
    sums = np.array([[r[f"s{k}"] for k in range(count)] for r in rows], float).reshape(len(rows), count)
    return held, sums / np.maximum(held, 1e-300)[:, None]


def allowed_tokens(supply: np.ndarray, weights: np.ndarray, most: float) -> float:
    """The most tokens that the supplies allow at the weights: no domain is asked for more than it has."""
    wanted = (weights > 0) & (supply > 0)
    return float(most * (supply[wanted] / weights[wanted]).min()) if wanted.any() else 0.0


def fit(members: DataFrame, weights: np.ndarray, settings: Settings) -> Fit:
    """Rates for members (_kd_tokens, _kd_chances), a stored table that every step reads once."""
    count, most = len(weights), settings.most
    tokens, chances = summary(members, count)
    supply = tokens @ chances if len(tokens) else np.zeros(count)
    if not supply.sum() or not weights.sum():
        return Fit(supply, supply, min(1.0, most), np.zeros(count))
    weights = weights / weights.sum()
    targets = settings.budget_share * allowed_tokens(supply, weights, most) * weights
    whole = tokens.sum()
    first = min(most, targets.sum() / whole)
    # The summary's solution is where the steps over all rows begin.
    bounds = (targets, PULL * whole)
    start, _ = descend(cell_sums(tokens, chances, first, most), *bounds, np.zeros(count), 200, settings.tolerance)
    sums = table_sums(members, count, first, most)
    found, totals = descend(sums, *bounds, start, settings.steps, settings.tolerance, STEP_GAIN)
    return Fit(targets, totals, first, found)


def mixed_documents(
    docs: DataFrame,
    labels: DataFrame,
    carried: list[str],
    weights: dict[str, float] | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """The carried columns with _kd_tokens, _kd_chances, _kd_rate and _kd_copies (times the row is drawn)."""
    settings = settings or Settings()
    weights = weights or WEIGHTS
    # Stored once: the steps below read two narrow columns of it, and scoring is not repeated.
    members = stored(memberships(docs, labels).select(*carried, "_kd_tokens", "_kd_chances"), "memberships")
    found = fit(members.select("_kd_tokens", "_kd_chances"), np.array([weights[d] for d in DOMAINS], float), settings)
    rated = members.withColumn("_kd_rate", rate(found.first, found.multipliers, settings.most))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("_kd_rate")
    return rated.withColumn("_kd_copies", (whole + (chance < F.col("_kd_rate") - whole).cast("long")).cast("long"))


def draw(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, settings: Settings | None = None
) -> DataFrame:
    """The rows of docs as often as the mixture takes them."""
    mixed = mixed_documents(docs, labels, docs.columns, weights, settings).filter(F.col("_kd_copies") > 0)
    if (settings or Settings()).most > 1:
        mixed = mixed.withColumn("_kd_copy", F.explode(F.sequence(F.lit(1), F.col("_kd_copies").cast("int")))).drop("_kd_copy")
    return mixed.select(*docs.columns)


def rates(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, settings: Settings | None = None
) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document."""
    mixed = mixed_documents(docs.select("doc_id", "text"), labels, ["doc_id"], weights, settings)
    return mixed.select(
        "doc_id",
        F.col("_kd_tokens").cast("long").alias("n_tokens"),
        *[F.col("_kd_chances")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)],
        F.col("_kd_rate").alias("rate"),
        F.col("_kd_copies").alias("copies"),
    )
