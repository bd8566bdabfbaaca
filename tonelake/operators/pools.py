"""Candidate pools in a combined space of scalar features and a spectral vector.

Scalars and spectral bands are scaled robustly per group, the bands reduced to the principal components that hold a share
of the variance, both blocks weighted to the same mean norm and joined. Distances, pools and outlier scores rest on that
space. A group is one pool of candidates (tens to hundreds of members), so a group is one Python task; a task holds the
n x n distances of one group, never a cube. Components have arbitrary signs, on which no distance depends.

Defined results: members with a missing or non-finite value are no members; repeated members count once; dimensions
without spread become zeros and stay; a group of one member is its own medoid, with distances 0; ties go to the lower
number (order of ids); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def forbid(features: Iterable[str], banned: str) -> None:
    """Raise ValueError if a feature that must stay out of distances is among them."""
    found = [f for f in features if banned in f]
    if found:
        raise ValueError(f"{banned} must not enter a distance: {', '.join(found)}")


def scaled(x: np.ndarray) -> np.ndarray:
    """(x - median) / IQR by column; columns of IQR <= 1e-10 become zeros."""
    q1, mid, q3 = np.percentile(x, [25, 50, 75], axis=0)
    flat = q3 - q1 <= 1e-10
    return np.where(flat, 0.0, (x - mid) / np.where(flat, 1.0, q3 - q1))


def component_scores(x: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Scores on the fewest components that hold `share` of the variance, and the share of every component."""
    x = x[:, x.var(axis=0) > EPS]
    most = min(len(x) - 1, x.shape[1])
    if most < 1:
        return np.zeros((len(x), 0)), np.zeros(0)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratio = s[:most] ** 2 / (s[:most] ** 2).sum()
    kept = min(most, int(np.searchsorted(np.cumsum(ratio), share - 1e-12)) + 1)
    return u[:, :kept] * s[:kept], ratio


def weighted(x: np.ndarray) -> np.ndarray:
    """A block divided by the root of its mean squared norm; zeros stay zeros."""
    size = np.sqrt((x**2).sum(axis=1).mean()) if x.size else 0.0
    return x / size if size > EPS else np.zeros_like(x)


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """n x n distances, row by row."""
    out = np.empty((len(x), len(x)))
    for i, row in enumerate(x):
        gap = np.abs(x - row)
        out[i] = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
    return out


def medoid(d: np.ndarray) -> int:
    return int(np.argmin(np.round(d.sum(axis=1), 9)))


def near_pairs(d: np.ndarray, listed: np.ndarray | None = None, share: float = 2.0) -> np.ndarray:
    """Which pairs are near duplicates: listed ones, and those within the `share` percentile of the positive distances (1e-9 at least)."""
    positive = d[d > 0]
    near = d <= max(1e-9, float(np.percentile(positive, share)) if positive.size else 1e-9)
    np.fill_diagonal(near, False)
    return near if listed is None else near | listed


def farthest(d: np.ndarray, size: int, near: np.ndarray) -> list[int]:
    """From the medoid on, the member with the greatest least distance to those chosen, then mean distance, then the lower number.

    A near duplicate of a chosen member comes behind all others, by mean distance, but for the last place, where it counts like any other.
    """
    chosen = [medoid(d)]
    number = np.arange(len(d))
    while len(chosen) < min(size, len(d)):
        to = d[:, chosen]
        least = np.round(to.min(axis=1), 9)
        if len(chosen) + 1 < size:
            least = np.where(near[:, chosen].any(axis=1), -1.0, least)
        least[chosen] = -2.0
        chosen.append(int(np.lexsort((-number, np.round(to.mean(axis=1), 9), least))[-1]))
    return chosen


def swapped_medoids(d: np.ndarray, size: int) -> list[int]:
    """Medoids by exchange: from a farthest-first start, the first place and candidate whose exchange lowers the sum of least distances, until none does."""
    chosen = farthest(d, size, np.zeros_like(d, dtype=bool))
    cost = d[:, chosen].min(axis=1).sum()
    place = 0
    while place < len(chosen):
        others = chosen[:place] + chosen[place + 1 :]
        without = d[:, others].min(axis=1) if others else np.full(len(d), np.inf)
        # the cost of every candidate in this place at once
        costs = np.minimum(without[:, None], d).sum(axis=0)
        costs[chosen] = np.inf
        better = np.flatnonzero(costs < cost - EPS)
        if len(better):
            chosen[place], cost, place = int(better[0]), float(costs[better[0]]), 0
        else:
            place += 1
    return chosen


def pair_stats(d: np.ndarray, chosen: list[int]) -> tuple[float, float]:
    """Least and mean distance of the pairs of a pool; zeros below two members."""
    if len(chosen) < 2:
        return 0.0, 0.0
    pairs = d[np.ix_(chosen, chosen)][np.triu_indices(len(chosen), 1)]
    return float(pairs.min()), float(pairs.mean())


class Space:
    """The combined space of one group."""

    def __init__(self, scalars: np.ndarray, spectrum: np.ndarray, share: float = 0.95):
        self.scalars = scaled(scalars)
        self.scores, self.ratio = component_scores(scaled(spectrum), share)
        self.spectral = weighted(self.scores)
        self.combined = np.hstack([weighted(self.scalars), self.spectral])
        self.d = distances(self.combined)

    def outliers(self) -> pd.DataFrame:
        """largest |scaled scalar|, distance to the spectral centre and to the combined medoid (both over their positive medians), their sum, and the nearest neighbour's distance."""
        centre = np.sqrt(((self.scores - np.median(self.scores, axis=0)) ** 2).sum(axis=1)) if self.scores.shape[1] else np.zeros(len(self.d))
        to_medoid = self.d[:, medoid(self.d)]
        by = lambda v: v / (float(np.median(v[v > 0])) + EPS if (v > 0).any() else 1.0)
        apart = self.d + np.where(np.eye(len(self.d), dtype=bool), np.inf, 0.0)
        largest = np.abs(self.scalars).max(axis=1)
        nearest = apart.min(axis=1) if len(self.d) > 1 else np.zeros(1)
        return pd.DataFrame({"largest": largest, "from_centre": by(centre), "from_medoid": by(to_medoid), "score": largest + by(centre) + by(to_medoid), "medoid_distance": to_medoid, "nearest": nearest})


def _grouped(pool: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(group's rows in id order, Space)` per group; `pool` has grp, member, scalars, spectrum and perhaps listed (near members' ids)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member", kind="stable").reset_index(drop=True)
        space = Space(np.array(pdf["scalars"].tolist(), dtype=float), np.array(pdf["spectrum"].tolist(), dtype=float).reshape(len(pdf), -1))
        out = fn(pdf, space)
        out.insert(0, "grp", pdf["grp"].iloc[0])
        return out

    return pool.groupBy("grp").applyInPandas(run, f"grp string, {schema}")


def combined_edges(pool: DataFrame) -> DataFrame:
    """(grp, i, j, combined, scalar, spectral, manhattan): the distances of each pair i < j of a group, members numbered in id order."""

    def edges(pdf: pd.DataFrame, s: Space) -> pd.DataFrame:
        i, j = np.triu_indices(len(pdf), 1)
        of = {"combined": s.d, "scalar": distances(weighted(s.scalars)), "spectral": distances(s.spectral), "manhattan": distances(s.combined, "manhattan")}
        return pd.DataFrame({"i": i + 1, "j": j + 1, **{n: d[i, j] for n, d in of.items()}})

    return _grouped(pool, edges, "i int, j int, combined double, scalar double, spectral double, manhattan double")


def outliers(pool: DataFrame) -> DataFrame:
    """(grp, member, largest, from_centre, from_medoid, score, medoid_distance, nearest) of every member."""
    return _grouped(pool, lambda pdf, s: s.outliers().assign(member=pdf["member"])[["member", "largest", "from_centre", "from_medoid", "score", "medoid_distance", "nearest"]], "member string, largest double, from_centre double, from_medoid double, score double, medoid_distance double, nearest double")


def quality_flags(pool: DataFrame, names: list[str], limit: float = 3.5) -> DataFrame:
    """(grp, member, flags): scaled scalars beyond `limit` by name, and near duplicates, joined by `;`."""

    def flags(pdf: pd.DataFrame, s: Space) -> pd.DataFrame:
        near = near_pairs(s.d, _listed(pdf)).any(axis=1)
        text = [";".join([*(f"extreme_{n}" for n, v in zip(names, row) if abs(v) > limit), *(["near_duplicate"] if near[k] else [])]) for k, row in enumerate(s.scalars)]
        return pd.DataFrame({"member": pdf["member"], "flags": text})

    return _grouped(pool, flags, "member string, flags string")


def _listed(pdf: pd.DataFrame) -> np.ndarray | None:
    if "listed" not in pdf:
        return None
    at = {m: k for k, m in enumerate(pdf["member"])}
    out = np.zeros((len(pdf), len(pdf)), dtype=bool)
    for k, ids in enumerate(pdf["listed"]):
        for m in ids if ids is not None else ():
            if m in at and at[m] != k:
                out[k, at[m]] = out[at[m], k] = True
    return out


def pools(pool: DataFrame, size: int) -> DataFrame:
    """(grp, member, position, distance): the farthest-point pool and each member's distance to those chosen before; all members where the group is no larger than `size`."""

    def choose(pdf: pd.DataFrame, s: Space) -> pd.DataFrame:
        start = medoid(s.d)
        if size >= len(pdf):
            return pd.DataFrame({"member": pdf["member"], "position": range(1, len(pdf) + 1), "distance": [0.0 if k == start else s.d[k, start] for k in range(len(pdf))]})
        at = farthest(s.d, size, near_pairs(s.d, _listed(pdf)))
        return pd.DataFrame({"member": pdf["member"].iloc[at].to_numpy(), "position": range(1, len(at) + 1), "distance": [0.0, *(float(s.d[k, at[:n]].min()) for n, k in enumerate(at) if n)]})

    return _grouped(pool, choose, "member string, position int, distance double")


def pool_methods(pool: DataFrame, size: int) -> DataFrame:
    """The same selection by four methods: (grp, method, candidates, members, least, mean, stability).

    Farthest-point on the combined space, medoids by exchange, farthest-point without the first scalar, and on Manhattan
    distances. Pair statistics are of the combined distances; stability is the share of the first pool that a method keeps.
    """

    def choose(pdf: pd.DataFrame, s: Space) -> pd.DataFrame:
        near = near_pairs(s.d, _listed(pdf))
        without = distances(np.hstack([weighted(s.scalars[:, 1:]), s.spectral]))
        picks = {"farthest_point": farthest(s.d, size, near), "medoids": swapped_medoids(s.d, size), "first_scalar_excluded": farthest(without, size, near), "manhattan": farthest(distances(s.combined, "manhattan"), size, near)}
        first = set(picks["farthest_point"])
        rows = [(m, len(at), "|".join(sorted(pdf["member"].iloc[at])), *pair_stats(s.d, at), len(first & set(at)) / len(first)) for m, at in picks.items()]
        return pd.DataFrame(rows, columns=["method", "candidates", "members", "least", "mean", "stability"])

    return _grouped(pool, choose, "method string, candidates int, members string, least double, mean double, stability double")


def best_subset(pool: DataFrame, size: int = 3, institutions: int = 2) -> DataFrame:
    """(grp, members, least, mean): of the subsets of `size` that hold the medoid and at least min(institutions, size) institutions, the one with the greatest least distance, then mean, then the first.

    `pool` also has `institution`. Subsets are grown from the medoid, so a group of n members gives C(n - 1, size - 1) of them, in arrays.
    """
    from itertools import combinations

    def choose(pdf: pd.DataFrame, s: Space) -> pd.DataFrame:
        m = medoid(s.d)
        rest = [k for k in range(len(pdf)) if k != m]
        sets = np.array([sorted((m, *c)) for c in combinations(rest, size - 1)], dtype=int).reshape(-1, size)
        if not len(sets):
            return pd.DataFrame({"members": pd.Series(dtype=str), "least": pd.Series(dtype=float), "mean": pd.Series(dtype=float)})
        codes = pd.factorize(pdf["institution"].fillna(""))[0][sets]
        varied = np.array([len(set(row)) for row in codes]) >= min(institutions, size)
        pairs = np.stack([s.d[sets[:, a], sets[:, b]] for a, b in combinations(range(size), 2)], axis=1)
        least, mean = np.round(pairs.min(axis=1), 9), np.round(pairs.mean(axis=1), 9)
        order = np.lexsort((np.arange(len(sets))[::-1], mean, least, varied))
        k = order[-1]
        return pd.DataFrame({"members": ["|".join(pdf["member"].iloc[sets[k]])], "least": [float(least[k])], "mean": [float(mean[k])]}) if varied[k] else pd.DataFrame({"members": pd.Series(dtype=str), "least": pd.Series(dtype=float), "mean": pd.Series(dtype=float)})

    return _grouped(pool, choose, "members string, least double, mean double")


def with_vectors(members: DataFrame, scalars: str = "x", spectrum: str = "bark") -> DataFrame:
    """Members with their scalars and spectrum, for the operators above; those without a whole spectrum are left out."""
    ok = F.col(spectrum).isNotNull() & ~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v))
    return members.where(ok).select("*", F.col(scalars).alias("scalars"), F.col(spectrum).cast("array<double>").alias("spectrum"))
