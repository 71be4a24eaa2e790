"""Settings of a run, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..operators.nn.train import LOSSES, Optimizer


@dataclass(frozen=True)
class Sampling:
    method: str = "random"
    split: float = 0.2
    seed: int = 112358
    clusters: int = 10

    def __post_init__(self):
        if self.method not in ("random", "kmeans", "gaussian_mixture", "spectral", "birch", "subgraph", "grid", "property_binning"):
            raise ValueError(f"no such sampling: {self.method}")
        if not 0 < self.split < 1:
            raise ValueError("split must lie between 0 and 1")


@dataclass(frozen=True)
class Model:
    species: int = 4
    dim: int = 100
    convs: int = 3
    cutoff: float = 4.0
    conv: str = "mesh"
    out_dim: int = 1
    interpretable: bool = False
    net: str = "line_graph"

    def __post_init__(self):
        if self.conv not in ("mesh", "gated", "gated_v2"):
            raise ValueError(f"no such convolution: {self.conv}")
        if self.net not in ("line_graph", "mesh_graph", "gated"):
            raise ValueError(f"no such network: {self.net}")
        if min(self.species, self.dim, self.convs, self.out_dim) < 1:
            raise ValueError("sizes must be at least 1")

    def settings(self) -> dict:
        """The arguments of the network, as training and prediction take them."""
        own = {"net": self.net, "species": self.species, "dim": self.dim, "convs": self.convs, "out_dim": self.out_dim}
        if self.net == "line_graph":
            return own | {"cutoff": self.cutoff, "conv": self.conv, "positive": self.interpretable}
        return own | ({"cutoff": self.cutoff} if self.net == "gated" else {})


@dataclass(frozen=True)
class Training:
    epochs: int = 250
    pretrain_epochs: int = 0
    batch_size: int = 100
    optimizer: str = "adam"
    learning_rate: float = 1e-3
    loss: str = "mse"
    max_deltas: int = 4
    tolerance: float = 1e-4
    most_loss: float = 1.0
    share: float = 0.1
    shuffle_steps: int = 10
    frozen: tuple[str, ...] = ()

    def __post_init__(self):
        if self.optimizer.lower() not in Optimizer.NAMES:
            raise ValueError(f"no such optimizer: {self.optimizer}")
        if self.loss not in LOSSES:
            raise ValueError(f"no such loss: {self.loss}")
        if self.epochs < 0 or self.pretrain_epochs < 0 or self.batch_size < 1 or self.learning_rate <= 0:
            raise ValueError("epochs, batch_size and learning_rate must be positive")


@dataclass(frozen=True)
class Run:
    sampling: Sampling = field(default_factory=Sampling)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    model_dir: str = "models"
    data_dir: str = "data"

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Run:
        d = json.loads(text)
        d["training"]["frozen"] = tuple(d["training"]["frozen"])
        return Run(Sampling(**d["sampling"]), Model(**d["model"]), Training(**d["training"]), d["model_dir"], d["data_dir"])
