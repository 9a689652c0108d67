"""Job settings: read from YAML, checked, and written back in a form that reads again."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

FORMATS = ("csv", "jsonl", "huggingface")
STRATEGIES = ("record", "field")
DEFAULT_EVOLUTION = [
    "Make the record richer in detail.", "Make the record harder without changing its topic.", "Rewrite the record in other words with the same meaning.", "Correct what is wrong or unclear in the record.",
]


def _known(cls: type, data: dict[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    for name in data.keys() - names:
        warnings.warn(f"{cls.__name__} has no setting {name!r}", stacklevel=3)
    return {k: v for k, v in data.items() if k in names}


@dataclass
class DataSource:
    """Where contexts are read from; ``fields`` empty means all columns."""

    uri: str
    format: str = "csv"
    fields: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.format = self.format.lower()
        if self.format not in FORMATS:
            raise ValueError(f"unsupported format: {self.format}")


@dataclass
class DataField:
    """A field to generate."""

    name: str
    type: str = "str"
    description: str = ""
    validator: str | None = None
    evolution_strategies: list[str] = field(default_factory=list)
    evolution_rate: float = 0.0
    store_full_reflection: bool = False


@dataclass
class Tag:
    """A named list of values; a weight that isn't given is kept as none and counts as 1 in draws."""

    name: str
    values: list[str]
    weights: list[float | None]

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError(f"tag {self.name!r} has no values")

    @classmethod
    def read(cls, data: dict[str, Any]) -> Tag:
        values, weights = [], []
        for v in data["values"]:
            weighted = isinstance(v, dict)
            values.append(str(v["value"] if weighted else v))
            weights.append(float(v["weight"]) if weighted else None)
        return cls(data["name"], values, weights)

    def add(self, values: str | list[str], weight: float | None = None) -> int:
        """Add values that aren't there in any case; how many were."""
        added = 0
        for value in [values] if isinstance(values, str) else values:
            if value.lower() not in {v.lower() for v in self.values}:
                self.values.append(value)
                self.weights.append(weight)
                added += 1
        return added

    def dump(self) -> dict[str, Any]:
        return {"name": self.name, "values": [v if w is None else {"value": v, "weight": w} for v, w in zip(self.values, self.weights, strict=True)]}


@dataclass
class Tags:
    """Tags by name, in any case."""

    tags: list[Tag] = field(default_factory=list)

    @classmethod
    def read(cls, data: Any) -> Tags:
        data = data or []
        return cls([Tag.read(t) for t in (data.get("tags", []) if isinstance(data, dict) else data)])

    @classmethod
    def from_json(cls, path: str) -> Tags:
        import json

        return cls.read(json.loads(Path(path).read_text()))

    def get(self, name: str) -> Tag | None:
        return next((t for t in self.tags if t.name.lower() == name.lower()), None)

    def add(self, tag: Tag) -> int:
        """1 if the tag is new, else 0."""
        if self.get(tag.name):
            return 0
        self.tags.append(tag)
        return 1

    def diversity(self) -> int:
        """How many combinations of values there are; 0 without tags."""
        out = 1 if self.tags else 0
        for tag in self.tags:
            out *= len(tag.values)
        return out

    def rows(self) -> list[tuple[str, list[str], list[float | None]]]:
        return [(t.name, t.values, t.weights) for t in self.tags]

    def to_yaml(self) -> str:
        return yaml.safe_dump({"contextual_tags": [t.dump() for t in self.tags]}, sort_keys=False, allow_unicode=True)


@dataclass
class Evolution:
    """How often records are evolved, how often over, and by which instructions."""

    rate: float = 0.0
    strategies: list[str] = field(default_factory=lambda: list(DEFAULT_EVOLUTION))


@dataclass
class DataModel:
    """A generation job."""

    fields: list[DataField]
    generation_instructions: str = ""
    data_source: DataSource | None = None
    contextual_tags: Tags | None = None
    num_examples: int = 10
    generation_strategy: str = "record"
    evolution: Evolution = field(default_factory=Evolution)
    evolution_generations: int = 1
    use_reflection: bool = True
    output_filename: str = "output.jsonl"
    llm_model: str = "offline"
    api_key: str | None = None

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("a job needs fields")
        if self.generation_strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.generation_strategy}")
        if self.data_source and self.contextual_tags and self.contextual_tags.tags:
            raise ValueError("a job has a data source or tags, not both")
        if self.num_examples < 0 or not 0 <= self.evolution.rate <= 1:
            raise ValueError("num_examples or evolution rate out of range")

    @classmethod
    def from_yaml(cls, text: str) -> DataModel:
        job = _known(cls, yaml.safe_load(text) or {})
        job["fields"] = [DataField(**_known(DataField, f)) for f in job.get("fields", [])]
        if job.get("data_source"):
            job["data_source"] = DataSource(**_known(DataSource, job["data_source"]))
        if job.get("contextual_tags"):
            job["contextual_tags"] = Tags.read(job["contextual_tags"])
        if job.get("evolution"):
            job["evolution"] = Evolution(**_known(Evolution, job["evolution"]))
        return cls(**job)

    def to_yaml(self) -> str:
        """Settings as YAML that reads back to the same job."""
        out: dict[str, Any] = {
            "generation_instructions": self.generation_instructions, "num_examples": self.num_examples, "generation_strategy": self.generation_strategy, "evolution": vars(self.evolution),
            "evolution_generations": self.evolution_generations, "use_reflection": self.use_reflection, "output_filename": self.output_filename, "llm_model": self.llm_model,
            "fields": [{k: v for k, v in vars(f).items() if v not in (None, [])} for f in self.fields],
        }
        if self.data_source:
            out["data_source"] = vars(self.data_source)
        if self.contextual_tags:
            out["contextual_tags"] = {"tags": [t.dump() for t in self.contextual_tags.tags]}
        return yaml.safe_dump(out, sort_keys=False, allow_unicode=True)

    def prompt_bytes(self) -> int:
        """Bytes of the settings that go into each prompt, without the tags."""
        parts = [self.generation_instructions, *self.evolution.strategies, *[x for f in self.fields for x in (f.name, f.type, f.description)]]
        return sum(len(x.encode()) for x in parts)


def read_model(text: str) -> DataModel | None:
    """A job from YAML, or None if it isn't one."""
    try:
        return DataModel.from_yaml(text)
    except (yaml.YAMLError, ValueError, TypeError, KeyError, AttributeError):
        return None


@dataclass
class AutoConfig:
    """A code job whose domains, topics and levels the model makes up."""

    code_lang: str = "python"
    num_domains: int = 10
    num_topics_per_domain: int = 10
    num_complexity_levels: int = 4
    syntax_validation: bool = True
    semantic_validation: bool = False
    artifact_path: str | None = None


@dataclass
class ManualConfig:
    """A code job with given domains and topics; a domain without topics gets some from the model."""

    complexity_levels: list[str]
    domain_and_topics: dict[str, list[str]]
    num_topics_per_domain: int = 5
    code_lang: str = "python"
    syntax_validation: bool = True
    semantic_validation: bool = False
    artifact_path: str | None = None


def load_code_config(config: str | Path | dict) -> AutoConfig | ManualConfig:
    """Settings from a path, YAML text or a dict; ``num_domains`` tells the automatic kind."""
    if isinstance(config, (str, Path)):
        text = Path(config).read_text() if "\n" not in str(config) and Path(config).exists() else str(config)
        config = yaml.safe_load(text)
    kind = AutoConfig if "num_domains" in config else ManualConfig
    return kind(**_known(kind, config))
