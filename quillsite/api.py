"""One object for a table split by site: check, prepare, measure, train, score and value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import kernels, kmeans, linear, linkage, metrics, networks, preprocess, ranking, stats, text, value
from .sources.sites import SiteFrame

#: What each way of combining sites offers. 1 and 2 combine sites at once, 3 visits them one by one, 4 and 5 average their
#: gradients, 6 adds up their rows. They compute in the open; none keeps anything secret.
MODELS = {
    1: ("Kmeans", "NN", "SVM", "FBSVM", "DSVM"),
    2: ("Kmeans", "NN", "SVM", "FBSVM"),
    3: ("Kmeans", "NN", "SVM", "FBSVM"),
    4: ("LR", "LC", "MLC", "Kmeans", "KR", "BSVM"),
    5: ("LR", "LC", "MLC", "Kmeans", "KR", "BSVM", "MBSVM"),
    6: ("RR", "KR", "LC", "MLC", "Kmeans", "BSVM", "MBSVM"),
}


@dataclass(frozen=True)
class Federation:
    """A SiteFrame with validation rows. Methods that prepare return a new Federation with both tables prepared."""

    train: SiteFrame
    validation: SiteFrame | None = None

    def select_sites(self, sites: list[int]) -> Federation:
        return replace(self, train=self.train.only(sites))

    def apply(self, step: Callable[[SiteFrame], SiteFrame]) -> Federation:
        """Both tables through a function of one, such as preprocess.log_scale or one's own."""
        return Federation(step(self.train), step(self.validation) if self.validation else None)

    # Preparation.

    def check(self, kinds: dict[str, tuple]) -> DataFrame:
        return preprocess.data_check(self.train.df, kinds, self.train.site)

    def encode(self, kinds: dict[str, tuple], strict: bool = True) -> Federation:
        """Every category of a schema as columns; nothing changes if it has none."""
        return self.apply(lambda sf: preprocess.one_hot_all(sf, kinds, strict))

    def one_hot(self, column: str, values: list[str]) -> Federation:
        def step(sf: SiteFrame) -> SiteFrame:
            made = tuple(f"{column}_{v}" for v in sorted(values))
            names = tuple(y for x in sf.features for y in (made if x == column else (x,)))
            return sf.having(preprocess.one_hot(sf.df, column, values), names)

        return self.apply(step)

    def normalise(self, how: str = "mean_std", keep: tuple[str, ...] = ()) -> Federation:
        """Both tables scaled by what the training rows say."""
        step = {"mean_std": preprocess.standardise, "min_max": preprocess.min_max}[how]
        if self.validation is None:
            return replace(self, train=step(self.train, keep))
        fitted = step(self.train, keep)
        facts = {r["feature"]: r for r in (stats.moments(self.train) if how == "mean_std" else stats.extremes(self.train)).collect()}

        def scaled(x: str):
            f = facts[x]
            shift, size = (f["mean"], f["std"]) if how == "mean_std" else (f["low"], (f["high"] - f["low"]) or 1.0)
            return (F.col(x) - F.lit(shift)) / F.lit(size) if size else F.col(x)

        cols = {x: scaled(x) for x in self.train.features if x not in keep}
        return Federation(fitted, self.validation.having(self.validation.df.withColumns(cols)))

    def project(self, matrix: np.ndarray) -> Federation:
        return self.apply(lambda sf: preprocess.project(sf, matrix))

    def random_projection(self, n: int, seed: int = 0, sparse: bool = False) -> Federation:
        return self.project(preprocess.random_matrix(len(self.train.features), n, seed, sparse))

    def pca(self, n: int) -> Federation:
        return self.project(preprocess.pca_matrix(self.train, n))

    def rank_features(self, n: int | None = None, least_gain: float = 0.0) -> list[tuple[str, float]]:
        if self.validation is None:
            raise ValueError("ranking needs validation rows")
        return ranking.greedy_features(self.train, self.validation, n, least_gain=least_gain)

    def most_frequent(self, n: int, most: float = 1.0) -> Federation:
        """The n features that are most often above zero."""
        at = [r["pos"] for r in text.top_features(self.train, n, most).collect()]
        return self.apply(lambda sf: preprocess.select(sf, at))

    # Measures.

    def statistics(self, normalised: bool = False) -> DataFrame:
        return stats.site_statistics(self.train, normalised)

    def class_counts(self, label: str) -> DataFrame:
        return stats.class_counts(self.train, label)

    def alignment(self) -> DataFrame:
        return value.task_alignment(self.train, self.validation)

    # Training and scoring.

    def fit(self, model: str, mode: int = 6, **how):
        """A trained model; how: what the model's own function takes, and nothing else. Kernel models need centroids and
        sigma. balance: the column of classes whose rows are to weigh alike, for linear models and budget SVMs."""
        if model not in MODELS.get(mode, ()):
            raise ValueError(f"mode {mode} has {', '.join(MODELS.get(mode, ()))}")
        sf, val = self.train, self.validation
        if balance := how.pop("balance", None):
            how["weight"] = stats.balancing(sf, balance)
        if model == "RR":
            return linear.ridge(sf, **how)
        if model in ("LR", "LC", "MLC"):
            how.setdefault("combine", "rows" if mode == 6 and model == "LC" else "site_mean")
            if model == "MLC" and "classes" not in how:
                label = how.get("label", "class")
                how["classes"] = sorted(r[0] for r in sf.df.select(label).distinct().collect())
            return linear.descend(sf, "linear" if model == "LR" else "sigmoid", validation=val if model == "LC" and mode == 6 else None, **how)
        if model == "Kmeans":
            how = {"least_rows": 1 if mode <= 3 else 3, "relocate": mode >= 4, "sequential": mode == 3} | how
            if mode >= 4 and "start" not in how:
                how["start"] = kmeans.random_start(sf, how["k"], how.pop("seed", 0))
            return kmeans.fit(sf, **how)
        if model == "NN":
            return networks.train(sf, how=how.pop("how", "sequential" if mode == 3 else "mean_weights"), **how)
        if model == "SVM":
            return kernels.svm(sf, combine={1: "mean", 2: "sum", 3: "sequential"}[mode], **how)
        if model == "FBSVM":
            return kernels.federated_svm(sf, sequential=mode == 3, **how)
        if model == "DSVM":
            return kernels.budget_svm(sf, validation=val, search=val is not None, **how)
        if model == "KR":
            return kernels.regress(sf, **({"steps": 20, "validation": val} if mode < 6 else {}) | how)
        if model == "BSVM" and mode == 4:
            return kernels.sign_svm(sf, validation=val, **how)
        how.setdefault("corner", 1.0 if mode == 5 else 1e-5)
        return kernels.budget_svm(sf, validation=val, **how)

    def accuracy(self, predicted: DataFrame, column: str, target: str) -> float:
        return metrics.accuracy(predicted, column, target).first()[0]

    # What sites are worth.

    def prior_value(self, sites: int, metric: Callable[[SiteFrame, SiteFrame, int], DataFrame] = value.rxy_span) -> DataFrame:
        """(site, value) before training: Shapley shares of a utility (mask, utility) of coalitions, the span by default."""
        return value.shares(value.shapley(metric(self.train, self.validation, sites), sites))

    def online_value(self, steps: int = 3, rate: float = 0.5, decay: float = 0.5) -> DataFrame:
        history, _ = value.online(self.train, self.validation, steps, rate)
        return value.decayed(history, decay)

    def value_of_products(self, ridge: float = 1e-2) -> DataFrame:
        return value.value_of_products(self.train, self.validation, ridge)

    def posterior_value(self) -> list[tuple[int, float]]:
        """(site, gain) in greedy order, by what each adds to a ridge regression on the validation rows."""
        own = value.site_matrices(self.train)
        v = stats.matrix(stats.gram(self.validation, by_site=False), ["1", *self.train.features, "y"])
        return value.greedy_sites(sorted(own), lambda chosen: value.ridge_utility(own, v, chosen))

    def posterior_auc(self, model: str = "LC", mode: int = 5, baseline: float = 0.0, **how) -> list[tuple[int, float, float]]:
        """(site, area, value) in greedy order, by the area under the curve of models fitted to the chosen sites."""
        return value.greedy_auc(self.train, self.validation, lambda sf: replace(self, train=sf).fit(model, mode, **how), baseline)


def link(frames: dict[int, tuple[DataFrame, str, str]], how: str = "full") -> DataFrame:
    """Vertically split tables met by hashed id: frames are site -> (rows, id column, order column)."""
    hashes = None
    for s, (df, id, _) in sorted(frames.items()):
        part = linkage.hash_ids({s: df}, id)
        hashes = part if hashes is None else hashes.unionByName(part)
    return linkage.vertical_concat(linkage.link(hashes, len(frames), how), frames)
