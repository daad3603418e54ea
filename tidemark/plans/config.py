"""A strict configuration: typed keys, no unknown ones, and a ledger of where each value came from."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

ORIGINS = ("detected", "declared", "default")
REQUIRED = object()


@dataclass(frozen=True)
class Key:
    kind: type | tuple[type, ...]
    default: Any = REQUIRED
    nullable: bool = False
    check: Any = None


#: Keys of the analysis with their defaults.
SCHEMA: dict[str, Key] = {
    "dataset": Key(str),
    "stride": Key(int, 1, check=lambda x: x >= 1),
    "labels.taus": Key(list, check=lambda x: x and all(t > 0 for t in x)),
    "labels.primary_tau": Key(int),
    "labels.source": Key(str, "auto", check=lambda x: x in ("own", "provided", "auto")),
    "seed": Key(int),
    "units": Key(list, ()),
    "profile.search_radius": Key(float, 6.0),
    "profile.step": Key(float, 0.5),
    "profile.angles": Key(int, 24),
    "profile.widest_gap": Key(float, 120.0),
    "profile.tolerance": Key(float, 0.05),
    "profile.pad": Key(float, 8.0),
    "models.penalties": Key(list, (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)),
    "models.arms": Key(list, ("linear", "trees", "clock", "control")),
    "models.head": Key(str, "trees"),
    "trees.rate": Key(float, 0.05),
    "trees.rounds": Key(int, 2000),
    "trees.patience": Key(int, 50),
    "trees.depths": Key(list, (2, 3, 4)),
    "trees.events_per_leaf": Key(list, (2, 4, 8)),
    "calibration.kind": Key(str, "sigmoid", check=lambda x: x in ("sigmoid", "isotonic")),
    "calibration.isotonic_least": Key(int, 200),
    "evaluation.alpha": Key(float, 0.05),
    "evaluation.draws": Key(int, 1000),
    "alarm.on_quantile": Key(float, 0.95),
    "alarm.off_quantile": Key(float, 0.80),
    "alarm.smoothing": Key(int, None, nullable=True),
    "transfer.most_lost": Key(float, 0.5),
    "missing.budget": Key(float, 0.5),
}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    values: dict[str, Any]
    ledger: dict[str, dict[str, str]] = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    def saved(self) -> dict:
        """Values that differ from defaults, and the ledger in order."""
        own = {k: v for k, v in self.values.items() if SCHEMA[k].default is REQUIRED or v != _plain(SCHEMA[k].default)}
        return {"values": own, "ledger": dict(sorted(self.ledger.items()))}


def _plain(x: Any) -> Any:
    return list(x) if isinstance(x, tuple) else x


def flatten(doc: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in doc.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def load(doc: dict, ledger: dict[str, dict[str, str]] | None = None) -> Config:
    given = flatten(doc)
    for k in given:
        if k not in SCHEMA:
            raise ConfigError(f"unknown key {k!r}")
    values = {}
    for k, spec in SCHEMA.items():
        v = given.get(k, _plain(spec.default) if spec.default is not REQUIRED else REQUIRED)
        if v is REQUIRED:
            raise ConfigError(f"{k} is required")
        if v is None:
            if not spec.nullable:
                raise ConfigError(f"{k} may not be null")
        else:
            if isinstance(v, int) and not isinstance(v, bool) and spec.kind is float:
                v = float(v)
            if not isinstance(v, spec.kind) or isinstance(v, bool) and spec.kind is not bool:
                raise ConfigError(f"{k} is not a {spec.kind.__name__}")
            if spec.check and not spec.check(v):
                raise ConfigError(f"{k} has the value {v!r}")
        values[k] = v
    for k, entry in (ledger or {}).items():
        if k not in SCHEMA:
            raise ConfigError(f"the ledger has the unknown key {k!r}")
        if entry.get("origin") not in ORIGINS:
            raise ConfigError(f"{k} has the origin {entry.get('origin')!r}")
        if entry["origin"] != "default" and not entry.get("basis"):
            raise ConfigError(f"{k} is {entry['origin']} without a basis")
    if values["labels.primary_tau"] not in values["labels.taus"]:
        raise ConfigError("labels.primary_tau is not among labels.taus")
    if values["models.head"] not in values["models.arms"]:
        raise ConfigError("models.head is not among models.arms")
    units = [json.dumps(u, sort_keys=True) for u in values["units"]]
    if len(set(units)) != len(units):
        raise ConfigError("a unit is listed twice")
    if values["alarm.on_quantile"] < values["alarm.off_quantile"]:
        raise ConfigError("the alarm turns off above where it turns on")
    return Config(values, dict(ledger or {}))


def choose_source(config: Config, own: int, provided: int) -> str:
    """The event source; `auto` refuses when there is a choice."""
    kind = config["labels.source"]
    if kind != "auto":
        return kind
    if own and provided:
        raise ConfigError("both event sources have events; set labels.source")
    return "own" if own else "provided"


def read(spark, path: str) -> Config:
    """A configuration and its ledger from a JSON file, as `write` leaves it or with keys in sections."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    doc = json.loads(text)
    return load(doc.get("values", doc), doc.get("ledger"))


def write(spark, folder: str, config: Config) -> None:
    """The values that differ from defaults and the ledger, as config.json in a folder that appears whole or not at all."""
    from tidemark.sources.sinks import step_output, write_text

    with step_output(spark, folder) as temp:
        write_text(spark, f"{temp}/config.json", json.dumps(config.saved(), indent=1, sort_keys=True))
