"""Parameters of the panel plans: folds, windows, weights, tolerances; optionally from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from pathlib import Path


@dataclass(frozen=True)
class Fold:
    name: str
    start: date
    end: date

    @property
    def train_end(self) -> date:
        """The month before the fold starts."""
        y, m = divmod(self.start.year * 12 + self.start.month - 2, 12)
        return date(y, m + 1, 1)


@dataclass(frozen=True)
class PanelConfig:
    folds: tuple[Fold, ...] = ()
    provisional_start: date = date(2025, 6, 1)
    shock: tuple[date, date] = (date(2020, 3, 1), date(2021, 12, 1))
    horizon: int = 1
    first_features_after: int = 12
    pressure_weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)
    tolerance: float = 1e-6
    minimum_improvement_pct: float = 5.0
    ridge_alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
    numeric_features: tuple[str, ...] = ()
    categorical_features: tuple[str, ...] = ()
    boolean_features: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        names = [*self.numeric_features, *self.categorical_features]
        if len(names) != len(set(names)):
            raise ValueError("a feature is listed twice")
        if self.horizon != 1:
            raise ValueError("only a horizon of one month is defined")

    @property
    def validation(self) -> tuple[Fold, ...]:
        return tuple(f for f in self.folds if f.name.startswith("validation"))


def load_yaml(path: str | Path) -> dict:
    """A YAML document that must be a non-empty mapping."""
    import yaml

    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(p)
    found = yaml.safe_load(p.read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{p}: a mapping is expected")
    return found


def from_yaml(path: str | Path, base: PanelConfig | None = None) -> PanelConfig:
    """``base`` with the keys of a YAML mapping; folds as name -> [start, end]."""
    given = dict(load_yaml(path))
    if "folds" in given:
        given["folds"] = tuple(Fold(n, date.fromisoformat(str(a)), date.fromisoformat(str(b))) for n, (a, b) in given["folds"].items())
    for k in ("numeric_features", "categorical_features", "boolean_features", "ridge_alphas", "pressure_weights"):
        if k in given:
            given[k] = tuple(given[k])
    return replace(base or PanelConfig(), **given)
