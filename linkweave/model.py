"""The data model: kinds, schemas, mappings, parameters, configuration and errors. Tables themselves are DataFrames.

A record table has record_id LONG, record_key STRING, source STRING (may be null) and the schema's fields.
"""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field

#: Agreement levels of a compared field; NULL marks a field that carries no evidence.
NONE, PARTIAL, CLOSE, EXACT, NULL = 0, 1, 2, 3, 255
AUTO_MATCH, BORDERLINE, AUTO_REJECT = "AutoMatch", "Borderline", "AutoReject"


class LinkError(Exception):
    """Base of all errors of this library."""


class EmptySchema(LinkError):
    pass


class UnknownField(LinkError):
    pass


class SchemaMismatch(LinkError):
    pass


class NotFitted(LinkError):
    pass


class StoreError(LinkError):
    pass


class SerializationError(LinkError):
    pass


class ConfigError(LinkError):
    pass


class JudgeError(LinkError):
    pass


class FieldKind(str, enum.Enum):
    NAME = "Name"
    DATE = "Date"
    ADDRESS = "Address"
    PHONE = "Phone"
    ID = "Id"
    FREE_TEXT = "FreeText"
    NUMERIC = "Numeric"
    CATEGORICAL = "Categorical"
    ALIAS = "Alias"
    LICENSE_PLATE = "LicensePlate"
    GPS = "GpsCoordinate"
    TIMESTAMP = "Timestamp"


@dataclass(frozen=True)
class FieldDef:
    name: str
    kind: FieldKind


@dataclass(frozen=True)
class Schema:
    """An ordered list of named, typed fields; at least one."""

    fields: tuple[FieldDef, ...]

    def __post_init__(self):
        if not self.fields:
            raise EmptySchema("a schema needs at least one field")

    @classmethod
    def of(cls, **kinds: FieldKind | str) -> Schema:
        return cls(tuple(FieldDef(n, FieldKind(k)) for n, k in kinds.items()))

    def of_kind(self, *kinds: FieldKind) -> list[str]:
        return [f.name for f in self.fields if f.kind in kinds]

    def index(self, name: str) -> int:
        for i, f in enumerate(self.fields):
            if f.name == name:
                return i
        raise UnknownField(name)

    def kind(self, name: str) -> FieldKind:
        return self.fields[self.index(name)].kind

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __len__(self) -> int:
        return len(self.fields)


class NullPolicy(str, enum.Enum):
    SKIP = "Skip"
    PENALISE = "PenaliseAbsence"


@dataclass(frozen=True)
class FieldMapping:
    """Field a_field of one source is compared with b_field of the other."""

    a_field: str
    b_field: str
    null_policy: NullPolicy = NullPolicy.SKIP


class LinkMode(str, enum.Enum):
    DEDUPLICATE = "deduplicate"
    LINK_ONLY = "link_only"
    LINK_AND_DEDUPE = "link_and_dedupe"

    @classmethod
    def parse(cls, text: str | LinkMode) -> LinkMode:
        if isinstance(text, cls):
            return text
        name = text.lower().replace("-", "_")
        name = {"dedupe": "deduplicate", "link_dedupe": "link_and_dedupe"}.get(name, name)
        try:
            return cls(name)
        except ValueError:
            raise ConfigError(f"unknown link mode: {text!r}") from None


@dataclass
class ModelParams:
    """Probabilities of each level among matches (m) and others (u), by field; prior and thresholds."""

    m: list[list[float]]
    u: list[list[float]]
    log_prior_odds: float
    upper_threshold: float = 0.9
    lower_threshold: float = 0.1

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ModelParams:
        try:
            return cls(**json.loads(text))
        except (ValueError, TypeError) as e:
            raise SerializationError(str(e)) from e


@dataclass
class ClusterConfig:
    max_cluster_size: int = 50
    within_cluster_min: float = 0.85


@dataclass
class RateConfig:
    """From fast_threshold records a second on, the upper threshold is divided by widening."""

    fast_threshold: float = 100.0
    slow_threshold: float = 10.0
    widening: float = 1.05


@dataclass
class PipelineConfig:
    link_mode: LinkMode = LinkMode.DEDUPLICATE
    max_bucket: int = 300
    cold_iterations: int = 25
    warm_iterations: int = 3
    upper_threshold: float | None = None
    lower_threshold: float | None = None
    field_mappings: list[FieldMapping] = field(default_factory=list)
    source_a: str | None = None
    missing_as_null: bool = False
    force_em: bool = False
    judge_edge_weight: str = "probability"
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    rate: RateConfig = field(default_factory=RateConfig)
