"""Recovery gates at the published sizes: models fitted on draws of known processes inside Spark tasks, and how near they come."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from panelforge.models import em, gp, hmm
from panelforge.session import ship_package

LENGTHSCALES = np.array([0.35, 0.6, 1.0, 1.5, 2.5])


def each_draw(spark: SparkSession, draws: int, measure: Callable[[int], pd.DataFrame], schema: str) -> DataFrame:
    """One task a draw."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["id"]:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)
                    yield measure(int(seed))

    return spark.range(0, draws, 1, draws).mapInPandas(run, schema)


def _sample(rng: np.random.Generator, x: np.ndarray, scales: np.ndarray, signal: float, noise: float) -> np.ndarray:
    return np.linalg.cholesky(gp.se_ard(x, x, scales, signal) + noise * np.eye(len(x))) @ rng.normal(size=len(x))


def _chain(rng: np.random.Generator, step: Callable[[int], np.ndarray], t: int) -> np.ndarray:
    states = [0]
    for i in range(1, t):
        states.append(int(rng.choice(2, p=step(i)[states[-1]])))
    return np.array(states)


def gp_fit_recovery(spark, d):
    """Length scales and noise recovered from ten draws of ten months of 80 points in five dimensions, four restarts."""

    def measure(seed: int) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        months = [rng.normal(0, 1.5, (80, 5)) for _ in range(10)]
        p, _ = gp.fit([(x, _sample(rng, x, LENGTHSCALES, 1.0, 0.01)) for x in months], restarts=4, seed=seed)
        return pd.DataFrame({"draw": seed, "feature": range(5), "truth": LENGTHSCALES, "fitted": p.lengthscales, "noise_var": p.noise_var})

    return each_draw(spark, 10, measure, "draw long, feature int, truth double, fitted double, noise_var double")


def hmm_recovery(spark, d):
    """The likeliest path of 300 steps of a two-state chain against the states that made it."""

    def measure(seed: int) -> pd.DataFrame:
        rng, a = np.random.default_rng(seed), np.array([[0.95, 0.05], [0.10, 0.90]])
        s = _chain(rng, lambda i: a, 300)
        x = rng.normal(2.0 * s, 0.7)
        log_b = -0.5 * ((x[:, None] - np.array([0.0, 2.0])) / 0.7) ** 2
        log_p = np.repeat(np.log(a)[None], 299, 0)
        gamma, _, _ = hmm.posteriors(np.log([0.5, 0.5]), log_p, log_b)
        path = hmm.viterbi(np.log([0.5, 0.5]), log_p, log_b)
        return pd.DataFrame([{"draw": seed, "path_accuracy": float((path == s).mean()), "posterior_accuracy": float((gamma.argmax(1) == s).mean())}])

    return each_draw(spark, 1, measure, "draw long, path_accuracy double, posterior_accuracy double")


def transition_recovery(spark, d):
    """Transition weights on two covariates recovered from 2000 steps of known states."""

    def measure(seed: int) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        z, w, b = rng.normal(size=(2000, 2)), np.zeros((2, 2, 2)), np.zeros((2, 2))
        w[0, 1], w[1, 1], b[0, 1], b[1, 1] = [1.2, -0.8], [-1.5, 0.5], -1.0, 2.0
        s = _chain(rng, lambda i: hmm.transition_matrix(w, b, z[i]), 2000)
        fw, fb = hmm.fit_transitions(z, em.hard_pairs(s, 2))
        return pd.DataFrame({"draw": seed, "from_state": [0, 0, 0, 1, 1, 1], "term": ["z0", "z1", "constant"] * 2, "truth": np.concatenate([[*w[j, 1], b[j, 1]] for j in range(2)]), "fitted": np.concatenate([[*fw[j, 1], fb[j, 1]] for j in range(2)])})

    return each_draw(spark, 1, measure, "draw long, from_state int, term string, truth double, fitted double")


def integrated_recovery(spark, d):
    """Regimes of 100 months of 100 entities in five dimensions, found by at most 25 rounds: agreement of the path with the true states."""

    def measure(seed: int) -> pd.DataFrame:
        rng, t, n = np.random.default_rng(seed + 5), 100, 100
        z, w, b = rng.normal(size=(t, 2)), np.zeros((2, 2, 2)), np.zeros((2, 2))
        w[0, 1], w[1, 1], b[0, 1], b[1, 1] = [1.0, 0.5], [0.5, 1.0], -2.0, 2.0
        s = _chain(rng, lambda i: hmm.transition_matrix(w, b, z[i]), t)
        scales, noise = (LENGTHSCALES, LENGTHSCALES[::-1]), (0.05, 0.5)
        x = [rng.normal(size=(n, 5)) for _ in range(t)]
        y = [_sample(rng, a, scales[k], 1.0, noise[k]) for a, k in zip(x, s)]
        res = em.fit_em(x, y, z, 0.1 + 0.2 * s + rng.normal(0, 0.1, t), em.EMConfig(max_iter=25, max_months_per_regime=None))
        _, accuracy = em.align_labels(s, res.path, 2)
        return pd.DataFrame([{"draw": seed, "accuracy": accuracy, "rounds": len(res.history), "converged": res.converged, "log_likelihood": res.full_log_likelihood}])

    return each_draw(spark, 1, measure, "draw long, accuracy double, rounds int, converged boolean, log_likelihood double")


def queries() -> dict:
    return {f.__name__: f for f in (gp_fit_recovery, hmm_recovery, transition_recovery, integrated_recovery)}
