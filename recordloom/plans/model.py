"""Model clients and the operator that calls them in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread

#: Settings of a call, which a caller's replace.
DEFAULTS = {"temperature": 0.8, "max_tokens": 2048, "top_p": 0.92}
#: Settings of each role of the suite of three, over which a caller's don't win.
ROLES = {"nl": {"temperature": 0.8, "max_tokens": 2048, "top_p": 0.92}, "code": dict(max_tokens=4096, temperature=0.2), "judge": dict(max_tokens=1024, temperature=0.1)}


class ModelClient(Protocol):
    """Anything that answers prompts; it must be picklable, and is called in the executors."""

    def generate(self, prompts: list[str], role: str, params: dict) -> list[str]: ...


#: What the model is told first: usually, and when it is to think before it answers.
SYSTEM = "You help to build data sets. Answer with what is asked for and nothing else."
REFLECTION = "Before you answer, reason about the task step by step inside <thinking> tags, and mend slips inside <reflection> tags within them. Then give the answer alone inside <output> tags."


_WORDS = "amber basin cedar delta ember field grove harbor island juniper kernel lantern meadow north orchard prairie".split()


@dataclass
class OfflineModel:
    """Answers made from the prompt alone, in the form that it asks for; faults come at the given rates, drawn from the prompt."""

    seed: int = 0
    fail_rate: float = 0.0
    missing_rate: float = 0.0
    bad_json_rate: float = 0.0

    def _u(self, asked: bytes, salt: str) -> float:
        return int.from_bytes(hashlib.md5(f"{self.seed}|{salt}|".encode() + asked).digest()[:4]) / 2**32

    def _phrase(self, asked: bytes, salt: str) -> str:
        return " ".join(_WORDS[int(self._u(asked, f"{salt}{i}") * len(_WORDS))] for i in range(6))

    def answer(self, text: str, role: str) -> str:
        task = re.search(r"^TASK: (\w+)", text, re.M)
        kind = task.group(1) if task else "text"
        prompt = text.encode()
        if self.bad_json_rate and self._u(prompt, "json") < self.bad_json_rate:
            return "{broken"
        if kind in ("judge", "validate"):
            return "FAIL: " + self._phrase(prompt, role) if self._u(prompt, kind) < self.fail_rate else "PASS"
        if kind in ("record", "field", "evolve"):
            names = re.search(r"^FIELDS: (.*)$", text, re.M)
            fields = [x for x in (names.group(1).split(", ") if names else []) if x]
            if self._u(prompt, "missing") < self.missing_rate:
                fields = fields[1:]
            return "\n".join(f"<<FIELD: {f}>>\n{self._phrase(prompt, f)}\n<<END_FIELD>>" for f in fields)
        if kind == "rank":  # what needs no phrase; hashing a long prompt is the most of an answer
            return "Here: " + json.dumps({"ranking": [{"text_index": 1}, {"text_index": 0}]})
        if kind == "select":
            return "Here: " + json.dumps({"selected_option": f"option_{1 + int(self._u(prompt, 'o') * 2)}"})
        say = self._phrase(prompt, role)
        made = {
            "mutate": lambda: {"mutated_text": say}, "improve": lambda: {"improved_text": say}, "describe": lambda: {"dataset_description": say}, "prompt": lambda: {"prompt": say}, "suggest": lambda: {"suggestions": [say, self._phrase(prompt, "2")]},
            "columns": lambda: {"columns": [{"column_name": f"{say.split()[i]}_{say.split()[i + 1]}", "quality_rank": i, "description": say, "all_values": say.split()} for i in range(4)]},
            "rubric": lambda: {k: {"score": int(self._u(prompt, k) * 5), "reasoning": say} for k in ("relevance", "correctness", "readability", "scalability", "standards", "efficiency", "pythonic")},
            "tags": lambda: [{"name": say.split()[i], "values": sorted(set(say.split()))} for i in range(3)], "rows": lambda: [dict(zip(("title", "body"), (say, self._phrase(prompt, f"r{i}")), strict=True)) for i in range(2)],
        }
        if kind in made:
            answer = json.dumps(made[kind]())
            return f"<thinking>{say}</thinking><output><json>{answer}</json></output>" if kind in ("columns", "tags", "rows") else "Here: " + answer
        if kind == "sql":
            return f"```sql\nSELECT '{say}' AS answer;\n```"
        if kind == "python":
            return f'```python\ndef answer():\n    """Give a phrase."""\n    return "{say}"\n```'
        if kind == "fix_sql":
            return f"SELECT '{say}' AS answer"
        if kind == "fix_python":
            return f'answer = "{say}"'
        if kind == "expand":
            names = re.search(r"^SEEDS: (.*)$", text, re.M)
            return "Here: " + json.dumps({"columns": [{"column_name": n, "all_values": sorted(set(self._phrase(prompt, n).split()))} for n in (names.group(1).split(", ") if names else [])]})
        if kind == "list":
            return json.dumps([f"{a}" for a in dict.fromkeys(say.split())])
        return say

    def generate(self, prompts: list[str], role: str, params: dict) -> list[str]:
        return [self.answer(p, role) for p in prompts]


@dataclass
class HttpModel:
    """A chat service that takes ``{model, messages, ...}`` and answers ``{choices: [{message: {content}}]}`` as JSON.

    Only the settings in ``SUPPORTED`` are sent; with ``flatten`` all messages go as one. ``parallel`` requests of a batch
    are under way at a time. A prompt whose request fails ``tries`` times has an empty answer.
    """

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    system: str = "You are a helpful assistant."
    tries: int = 3
    timeout: float = 60.0
    parallel: int = 8
    flatten: bool = False

    SUPPORTED = ("temperature", "max_tokens", "top_p", "top_k")

    def generate(self, prompts: list[str], role: str, params: dict) -> list[str]:
        sent = {name: params[name] for name in self.SUPPORTED if name in params}
        if not prompts:
            return []
        with ThreadPoolExecutor(min(self.parallel, len(prompts))) as pool:
            return list(pool.map(lambda p: self._one(p, sent), prompts))

    def _one(self, prompt: str, params: dict) -> str:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        if self.flatten:
            messages = [{"role": "user", "content": flatten_messages(messages)}]
        body = {"model": self.model, "messages": messages, **params}
        request = Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        for _ in range(self.tries):
            try:
                with urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except (URLError, TimeoutError, json.JSONDecodeError, KeyError, IndexError):
                continue
        return ""


def flatten_messages(messages: list[dict[str, str]]) -> str:
    """One prompt from several messages, each under its role; a single one as it is."""
    if len(messages) == 1:
        return messages[0]["content"]
    return "\n\n".join(f"{m['role'].upper()}:\n{m['content']}\n---" for m in messages)


def ask_json(df: DataFrame, prompt: str, client: ModelClient, role: str = "nl") -> DataFrame:
    """``df`` with ``thinking`` and ``json``: an answer's reasoning, and the repaired JSON of its output (an error object if there is none)."""
    from ..functions import jsonx, text

    asked = apply_model(df, prompt, "__answer", client, role)
    return asked.withColumn("thinking", text.extract_thinking(F.col("__answer"))).withColumn("json", jsonx.tagged_json(text.extract_output(F.col("__answer")))).drop("__answer")


def infer(df: DataFrame, prompt: str, out: str, client: ModelClient, use_reflection: bool = False, keep_thinking: bool = False, system: str | None = None, role: str = "nl", params: dict | None = None) -> DataFrame:
    """``df`` with the answer to each prompt, put after a system message and cleaned, and ``bytes_read`` and ``bytes_written`` of the prompt and of the cleaned answer.

    With ``use_reflection`` the model is told to think first, whatever ``system`` says; its output is taken, or with
    ``keep_thinking`` the whole answer, and blocks of thinking are removed. Without it, newlines are tidied. A null prompt costs no call.
    """
    from ..functions import text

    told = REFLECTION if use_reflection else SYSTEM if system is None else system
    asked = apply_model(df.withColumn("__full", text.assembled(told, F.col(prompt))), "__full", out, client, role, params).drop("__full")
    answer = F.col(out)
    if use_reflection:
        answer = text.remove_thinking(answer if keep_thinking else text.split_reflection(answer)["output"])
    else:
        answer = text.tidy_newlines(answer)
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    asked = asked.withColumn(out, F.when(F.col(out).isNotNull(), answer))
    return asked.withColumn("bytes_read", size(prompt)).withColumn("bytes_written", size(out))


def apply_model(df: DataFrame, prompt: str, out: str, client: ModelClient, role: str = "nl", params: dict | None = None, batch: int = 256, suite: bool = False) -> DataFrame:
    """``df`` with the answer to each prompt, from batches; a null prompt costs no call and has a null answer.

    A caller's settings replace ``DEFAULTS``; in the ``suite`` of three roles those of the role win over the caller's.
    The answers are marked as not deterministic, so that the planner never asks twice within one plan. A prompt may be
    an array of prompts; its answer is the array of their answers. A small table is spread over all slots.
    """
    settings = (params or {}) | ROLES.get(role, {}) if suite else DEFAULTS | (params or {})
    kind = df.schema[prompt].dataType.simpleString()

    def ask_all(prompts: list[str | None]) -> list[str | None]:
        answers: list[str | None] = [None] * len(prompts)
        places = [i for i, p in enumerate(prompts) if p is not None and p == p]
        for a in range(0, len(places), batch):
            part = places[a : a + batch]
            for i, text in zip(part, client.generate([prompts[i] for i in part], role, settings), strict=True):
                answers[i] = text
        return answers

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in columns:
            if kind == "array<string>":
                rows = [None if p is None else list(p) for p in prompts]
                flat = iter(ask_all([p for row in rows if row is not None for p in row]))
                answers: list = [None if row is None else [next(flat) for _ in row] for row in rows]
            else:
                answers = ask_all(prompts.tolist())
            yield pd.Series(answers, dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    ask = F.pandas_udf(run, "array<string>" if kind == "array<string>" else "string").asNondeterministic()
    return spread(df).withColumn(out, ask(F.col(prompt)))


@dataclass
class ModelEntry:
    """A configured model."""

    name: str
    params: dict = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)


CONTROL_KEYS = ("model", "api_key", "api_base", "api_type")


def resolve(value, depth: int = 3):  # noqa: ANN001, ANN201
    """``os.environ/NAME`` in nested settings, down to three levels, replaced by the variable."""
    if isinstance(value, dict) and depth:
        return {k: resolve(v, depth - 1) for k, v in value.items()}
    if isinstance(value, str) and value.startswith("os.environ/"):
        name = value.removeprefix("os.environ/")
        if name not in os.environ:
            raise KeyError(f"{name} is not set")
        return os.environ[name]
    return value


def registry(config: list[dict] | str, fail_on_error: bool = True) -> list[ModelEntry]:
    """Models from a list of settings, YAML text or a YAML file; one whose secrets are missing raises, or is left out."""
    import yaml

    if isinstance(config, str):
        config = yaml.safe_load(open(config) if os.path.exists(config) else config)
    out = []
    for entry in config:
        try:
            out.append(ModelEntry(entry["model_name"], resolve(entry.get("litellm_params", entry.get("params", {}))), list(entry.get("tags", []))))
        except KeyError:
            if fail_on_error:
                raise
    return out


def find_by_tags(models: list[ModelEntry], required: list[str]) -> list[ModelEntry]:
    """Models with all of the tags, in order."""
    return [m for m in models if set(required) <= set(m.tags)]


def call_params(model: ModelEntry) -> dict:
    """A model's settings without those that name it and its server."""
    return {k: v for k, v in model.params.items() if k not in CONTROL_KEYS}



@dataclass
class Router:
    """Several configured models behind one client: those of a name take turns, and where one fails or answers nothing the next is asked."""

    clients: dict[str, list[ModelClient]]
    name: str

    def generate(self, prompts: list[str], role: str, params: dict) -> list[str]:
        own = self.clients[self.name]
        answers: list[str | None] = [None] * len(prompts)
        for turn in range(len(own)):
            for k, client in enumerate(own):
                open_ = [i for i, a in enumerate(answers) if not a and (i + turn) % len(own) == k]
                if not open_:
                    continue
                try:
                    got = client.generate([prompts[i] for i in open_], role, params)
                except OSError:
                    continue
                for i, text in zip(open_, got, strict=True):
                    answers[i] = text
        return [a or "" for a in answers]

    def of(self, name: str) -> Router:
        """The same models, asked under another name."""
        if name not in self.clients:
            raise KeyError(f"no model {name!r}")
        return Router(self.clients, name)


def http_client(entry: ModelEntry) -> HttpModel:
    """A client for a configured model: its server is ``api_base``."""
    headers = {"Authorization": f"Bearer {entry.params['api_key']}"} if entry.params.get("api_key") else {}
    return HttpModel(entry.params["api_base"], entry.params.get("model", entry.name), headers)


def create_router(models: list[ModelEntry], make: Callable[[ModelEntry], ModelClient] = http_client) -> Router:
    """A router over configured models, first asked under the name of the first."""
    if not models:
        raise ValueError("no models")
    clients: dict[str, list[ModelClient]] = {}
    for entry in models:
        clients.setdefault(entry.name, []).append(make(entry))
    return Router(clients, models[0].name)


def list_models(models: list[ModelEntry]) -> list[str]:
    """The distinct names of configured models, in order."""
    return list(dict.fromkeys(m.name for m in models))
