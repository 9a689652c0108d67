"""Pipelines of named steps, and suites of prompts by name: where jobs of one's own are put in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..functions.text import names_in, render
from ..operators.common import saved

Step = Callable[[DataFrame], DataFrame]
PIPELINES: dict[str, Pipeline] = {}
PROMPTS: dict[str, PromptSuite] = {}


@dataclass(frozen=True)
class Pipeline:
    """Steps from table to table, one after the other. A step that is ``kept`` is written to the shared folder: what it costs, such as answers of a model, is paid once."""

    name: str
    steps: tuple[tuple[str, Step, bool], ...] = ()

    def then(self, name: str, step: Step, kept: bool = False) -> Pipeline:
        """This pipeline with another step."""
        if name in self.names():
            raise ValueError(f"{self.name} has a step {name!r} already")
        return Pipeline(self.name, (*self.steps, (name, step, kept)))

    def names(self) -> list[str]:
        """The names of the steps, in order."""
        return [name for name, _, _ in self.steps]

    def replaced(self, name: str, step: Step) -> Pipeline:
        """This pipeline with another function for a step."""
        if name not in self.names():
            raise KeyError(name)
        return Pipeline(self.name, tuple((n, step if n == name else s, k) for n, s, k in self.steps))

    def run(self, df: DataFrame, until: str | None = None) -> DataFrame:
        """The table after all steps, or after the one named."""
        if until is not None and until not in self.names():
            raise KeyError(until)
        for name, step, kept in self.steps:
            df = step(df)
            df = saved(df) if kept else df
            if name == until:
                break
        return df


def register_pipeline(pipeline: Pipeline) -> Pipeline:
    """Make a pipeline known by its name."""
    PIPELINES[pipeline.name] = pipeline
    return pipeline


@dataclass(frozen=True)
class PromptSuite:
    """Prompt templates by name, with ``{placeholders}``."""

    name: str
    templates: dict[str, str] = field(default_factory=dict)

    def changed(self, name: str, **templates: str) -> PromptSuite:
        """A suite of another name with some templates replaced. A template must use the placeholders of the one it replaces, or fewer."""
        for key, template in templates.items():
            if extra := set(names_in(template)) - set(names_in(self.templates.get(key, template))):
                raise ValueError(f"{key} has no {', '.join(sorted(extra))}")
        return PromptSuite(name, self.templates | templates)

    def __getitem__(self, key: str) -> str:
        return self.templates[key]

    def fill(self, key: str, values: dict[str, Column | str]) -> Column:
        """A prompt for each row."""
        return render(self.templates[key], values)


def register_prompts(suite: PromptSuite) -> PromptSuite:
    """Make a suite known by its name."""
    PROMPTS[suite.name] = suite
    return suite
