"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ampliq.llm.common import lower_ascii
from ampliq.llm.url_labels import labelled_urls

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or where there is no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, or null.  The rule list is a parameter, meant for hundreds of rules."""
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), r.name)
        for r in longest_first
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def hashed_ngrams(host: str, path: str, sizes: Sequence[int], buckets: int) -> list[int]:
    """Bucket of each character n-gram of host and path, which are kept apart; both ends are marked."""
    found = []
    for kind, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            found += [zlib.crc32((kind + part[i : i + n]).encode("utf-8", "replace")) % buckets
                      for i in range(len(part) - n + 1)]
    return found or [0]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def block_probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        if not len(hosts):
            return np.zeros(0)
        grams = [hashed_ngrams(h, p, self.sizes, len(self.weights)) for h, p in zip(hosts, paths)]
        starts = np.cumsum([0, *map(len, grams[:-1])])
        sums = np.add.reduceat(self.weights[np.concatenate(grams)], starts)
        means = sums / np.sqrt([len(g) for g in grams])
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -30, 30)))


def loss_and_slope(
    weights: np.ndarray, bias: float, grams: Sequence[Sequence[int]], answers: np.ndarray, decay: float
) -> tuple[float, np.ndarray, float]:
    """Logistic loss with both answers weighing the same in all, and its slope by weights and bias."""
    lengths = np.array([len(g) for g in grams])
    starts, flat, scale = np.cumsum([0, *lengths[:-1]]), np.concatenate(grams), 1 / np.sqrt(lengths)
    balance = np.where(answers == 1, 0.5 / answers.sum(), 0.5 / (1 - answers).sum())
    odds = np.clip(np.add.reduceat(weights[flat], starts) * scale + bias, -30, 30)
    chance = 1 / (1 + np.exp(-odds))
    error = (chance - answers) * balance
    loss = -(balance * np.log(np.where(answers == 1, chance, 1 - chance))).sum() + decay / 2 * (weights**2).sum()
    slope = np.bincount(flat, weights=np.repeat(error * scale, lengths), minlength=len(weights)) + decay * weights
    return float(loss), slope, float(error.sum())


def train(
    labelled: DataFrame, max_rows: int = 10_000, buckets: int = 1 << 15, sizes: tuple[int, ...] = (3, 4, 5),
    rounds: int = 300, decay: float = 1e-5, prior: float = 0.2,
) -> UrlModel:
    """Fit on a labelled table (host, path, blocked 0/1) of which at most ``max_rows`` distinct rows are used.

    Where there are more, each verdict gives its half of the bound, chosen by a hash of the row.  ``prior`` is the
    share of URLs that are expected to be blocked: a URL of which the model knows nothing has about that chance.
    With one verdict only, the model gives that verdict; without any row it allows.
    """
    distinct = labelled.select("host", "path", "blocked").distinct()
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path"), F.col("blocked")]
    rows = [
        row
        for verdict in (0, 1)
        for row in distinct.where(F.col("blocked") == verdict).orderBy(*order).limit(max_rows // 2).collect()
    ]
    answers = np.array([row.blocked for row in rows], dtype=float)
    weights = np.zeros(buckets)
    if not len(answers) or answers.min() == answers.max():
        return UrlModel(weights, 30.0 if len(answers) and answers[0] else -30.0, sizes)
    grams = [hashed_ngrams(row.host, row.path, sizes, buckets) for row in rows]
    bias, pace = 0.0, np.zeros(buckets)
    for _ in range(rounds):
        _, slope, tilt = loss_and_slope(weights, bias, grams, answers, decay)
        pace += slope**2
        weights -= 0.5 * slope / np.sqrt(pace + 1e-12)
        bias -= 0.5 * tilt
    return UrlModel(weights, float(bias + np.log(prior / (1 - prior))), sizes)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", labelled: DataFrame | None = None,
    max_labelled: int = 10_000, prior: float = 0.2,
) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``chance`` of a block and ``verdict``; input columns are kept.

    ``labelled`` is a small table (url, blocked 0/1), by default the one in ``url_labels``; it has nothing to do with
    the rules.  The model is trained on at most ``max_labelled`` of its URLs and applied to every row, each on its own,
    so repeated URLs, frequent hosts and long URLs cost no exchange; it decides where no rule fits.  Null URLs and those
    without ``://`` have empty parts, fit no rule and are judged by the model; an empty table gives an empty result;
    columns of the same names are replaced.
    """
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(list(labelled_urls()), "url string, blocked int")
    blocking = [r.name for r in rules if r.verdict == "block"]
    told = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked")
    model = train(told, max_labelled, prior=prior)

    @F.pandas_udf(DoubleType())
    def chance(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.block_probability(host.tolist(), path.tolist()))

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "chance", "verdict")]
    found = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("chance", chance("host", "path"))
    by_rule = F.when(F.col("rule").isin(blocking), "block").when(F.col("rule").isNotNull(), "allow")
    by_model = F.when(F.col("chance") >= 0.5, "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce(by_rule, by_model))
