"""Run settings: one flat, frozen object, loadable from a flat JSON file."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime

# The nine interaction types, strongest first (the order of exports).
INTERACTION_PRIORITY = (
    "purchase", "cart", "like", "view3", "view2", "view1", "impression3", "impression2", "impression1",
)

# Weight of each interaction type. "review" has no source and is accepted but unused.
DEFAULT_WEIGHTS = {
    "impression1": -1.0,
    "impression2": -2.0,
    "impression3": -3.0,
    "view1": 2.0,
    "view2": 4.0,
    "view3": 6.0,
    "like": 5.0,
    "cart": 7.0,
    "purchase": 10.0,
    "review": 10.0,
}


# Where recommendations can be saved.
DB_TYPES = ("postgres", "mysql", "parquet")


@dataclass(frozen=True)
class Thresholds:
    """Smallest count for tiers 1, 2 and 3 of views and of impressions."""

    view: tuple[int, int, int] = (3, 6, 10)
    impression: tuple[int, int, int] = (3, 6, 10)

    @classmethod
    def from_flat(cls, flat: dict[str, int]) -> Thresholds:
        """Build from keys ``view1`` .. ``impression3``; a missing key keeps its default."""
        tiers = {}
        for f in dataclasses.fields(cls):
            tiers[f.name] = tuple(int(flat.get(f"{f.name}{i + 1}", f.default[i])) for i in range(3))
        return cls(**tiers)


@dataclass(frozen=True)
class RunConfig:
    max_iter: int = 10
    reg_param: float = 0.1
    rank: int = 10
    nonnegative: bool = False
    cold_start_strategy: str = "nan"
    als_blocks: int = 10
    als_block_rows: int = 200_000_000
    interaction_weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    interaction_thresholds: Thresholds = field(default_factory=Thresholds)
    days: int = 10
    ignore_case: bool = False
    top_n: int = 100
    split_test_data: bool = False
    test_ratio: float = 0.2
    random_seed: int = 42
    als_seed: int | None = None
    save_to_db: bool = False
    db_type: str = "postgres"

    def __post_init__(self):
        check_weights(self.interaction_weights)
        if self.cold_start_strategy not in ("nan", "drop"):
            raise ValueError(f"cold_start_strategy must be 'nan' or 'drop', got {self.cold_start_strategy!r}")
        if self.als_blocks < 1:
            raise ValueError(f"als_blocks must be at least 1, got {self.als_blocks}")
        if self.als_block_rows < 1:
            raise ValueError(f"als_block_rows must be at least 1, got {self.als_block_rows}")
        if self.db_type not in DB_TYPES:
            raise ValueError(f"unsupported database type: {self.db_type}")
        if self.split_test_data and not 0 < self.test_ratio < 1:
            raise ValueError(f"test_ratio must lie between 0 and 1, got {self.test_ratio}")

    @classmethod
    def from_dict(cls, raw: dict) -> RunConfig:
        names = {f.name for f in dataclasses.fields(cls)}
        unknown = sorted(set(raw) - names)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        values = dict(raw)
        if "interaction_weights" in values:
            values["interaction_weights"] = {k: float(v) for k, v in values["interaction_weights"].items()}
        if "interaction_thresholds" in values:
            values["interaction_thresholds"] = Thresholds.from_flat(values["interaction_thresholds"])
        return cls(**values)

    @classmethod
    def load(cls, path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @property
    def model_seed(self) -> int:
        return self.random_seed if self.als_seed is None else self.als_seed

    def echo(self) -> dict:
        """The settings worth showing in a run report."""
        return {
            "days": self.days,
            "top_n": self.top_n,
            "max_iter": self.max_iter,
            "rank": self.rank,
            "als_blocks": self.als_blocks,
            "split_test_data": self.split_test_data,
            "save_to_db": self.save_to_db,
            "db_type": self.db_type,
        }

    def snapshot_key(self, as_of: datetime, source: str = "") -> str:
        """Short hash of all that changes the interaction set: the settings, the moment and the logs it is built from."""
        parts = [as_of.isoformat(), self.days, self.interaction_thresholds.view,
                 self.interaction_thresholds.impression, self.ignore_case, source]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:12]


def check_weights(weights: dict[str, float]) -> None:
    """Every type the sources can produce needs a finite weight, or ALS would meet NULL ratings."""
    missing = [t for t in INTERACTION_PRIORITY if weights.get(t) is None or weights[t] != weights[t]]
    if missing:
        raise ValueError(f"interaction types without a weight: {', '.join(missing)}")
