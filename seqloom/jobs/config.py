"""Settings of the jobs, with defaults and checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# fixed values: settings of plots, and one without effect
NO_EFFECT = ("oned_plots", "plot_cuts", "unweighted")


@dataclass(frozen=True)
class ClassConfig:
    """Discovery of symbol classes."""

    method: str = "spectral"
    window: int = 2
    separate_lens: bool = True
    graph_type: str = "KLD"
    smoothing: float = 2e-4
    eigengap: bool = True
    min_embs: int = 4
    PPMI_threshold: float = 0.0
    sign_cut: bool = True
    use_jenks: bool = True
    max_cuts: int = 2
    mod_threshold: float = -100.0
    norm_lap: bool = True
    mod_matrix: bool = False
    PMI: bool = False
    num_embs: int = 0
    max_clusters: int = 3
    seed: int = 1

    def __post_init__(self) -> None:
        if self.method not in ("spectral", "recurse"):
            raise ValueError(f"unknown method {self.method}")
        if self.window < 1 or self.max_cuts < 2:
            raise ValueError("window must be at least 1, max_cuts at least 2")
        if self.mod_matrix and self.norm_lap:
            raise ValueError("the modularity matrix needs norm_lap = 0")

    @property
    def matrix(self) -> str:
        """The kind of matrix whose spectrum is taken."""
        return "walk" if self.norm_lap else "modularity" if self.mod_matrix else "plain"


@dataclass(frozen=True)
class ModelConfig:
    """Fit of the log-linear model. Weights are never negative, whatever non_negative says; opt names the only optimiser."""

    N: int = 2
    word_boundaries: bool = True
    syll_boundaries: bool = False
    type_frequency: bool = False
    singletons: bool = False
    n_iter: int = 1000
    lr: float = 0.1
    lam: float = 0.001
    non_negative: bool = True
    opt: str = "SGD"
    match: str = "token"  # or substring

    def __post_init__(self) -> None:
        if self.opt != "SGD":
            raise ValueError(f"unknown optimiser {self.opt}")
        if self.match not in ("token", "substring"):
            raise ValueError(f"unknown way to match {self.match}")
        if self.N < 1 or self.n_iter < 0 or self.lr <= 0:
            raise ValueError("N and lr must be positive, n_iter not negative")


def load(path: str) -> tuple[ClassConfig, ModelConfig]:
    """The sections class and phonotactic of a JSON file. Keys for plots, and one that never had a meaning, are left out; others that are unknown are refused. Matching is by substring unless the file says otherwise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def build(kind: type, section: str):
        known = {f.name: f.type for f in fields(kind)}
        given = {k: v for k, v in spec.get(section, {}).items() if k not in NO_EFFECT}
        if unknown := given.keys() - known.keys():
            raise ValueError(f"unknown settings in {section}: {', '.join(sorted(unknown))}")
        return kind(**{k: bool(v) if known[k] == "bool" else v for k, v in given.items()})

    spec["phonotactic"] = {"match": "substring"} | spec.get("phonotactic", {})  # what a flow of files has always meant
    return build(ClassConfig, "class"), build(ModelConfig, "phonotactic")
