"""Configuration: a YAML file of nested maps, defaults, checks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class LLM:
    base_url: str = "https://api.openai.com/v1"
    api_key_env: str = ""
    planner_model: str = "gpt-4o-mini"
    preprocessor_model: str = "gpt-4o-mini"
    agent_model: str = "gpt-4o"
    max_tokens: int = 4096
    temperature: float = 0.2
    timeout_seconds: int = 120
    api_key: str = field(default="", repr=False, metadata={"derived": True})


@dataclass
class Analysis:
    languages: list[str] = field(default_factory=lambda: ["go", "python", "typescript", "rust", "java"])
    exclude_patterns: list[str] = field(default_factory=lambda: ["*_test.go", "vendor/**", "node_modules/**", "**/*.pb.go"])
    shared_module_threshold: int = 3


@dataclass
class Agent:
    concurrency: int = 4
    skeleton_max_tokens: int = 3000


@dataclass
class Cache:
    enabled: bool = True
    dir: str = "./artifacts/cache"


@dataclass
class Site:
    title: str = ""
    repo_url: str = ""
    logo: str = ""


@dataclass
class Config:
    repo_path: str = "."
    output_dir: str = "./docs"
    artifacts_dir: str = "./artifacts"
    llm: LLM = field(default_factory=LLM)
    analysis: Analysis = field(default_factory=Analysis)
    agent: Agent = field(default_factory=Agent)
    cache: Cache = field(default_factory=Cache)
    site: Site = field(default_factory=Site)
    verbose: bool = field(default=False, metadata={"derived": True})


class ConfigError(ValueError):
    """The file cannot be read, or a value is out of its range."""


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'" and len(s) > 1 and s[-1] == s[0]:
        return json.loads(s) if s[0] == '"' else s[1:-1].replace("''", "'")
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    for value, words in ((True, ("true", "True")), (False, ("false", "False")), (None, ("", "~", "null"))):
        if s in words:
            return value
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _bare(line: str) -> str:
    """The line without a comment that stands outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def parse_yaml(text: str) -> dict:
    """The block subset that configuration files use: nested maps, lists of scalars, flow lists."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    waiting: tuple[int, dict, str] | None = None
    for number, raw in enumerate(text.split("\n"), 1):
        line = _bare(raw)
        if not line.strip() or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if "\t" in line[:indent]:
            raise ConfigError(f"line {number}: a tab in the indent")
        if body == "-" or body.startswith("- "):
            if waiting is None or indent < waiting[0]:
                raise ConfigError(f"line {number}: a list item outside a list")
            held = waiting[1].get(waiting[2])
            if not isinstance(held, list):
                held = waiting[1][waiting[2]] = []
            held.append(_scalar(body[1:]))
            continue
        key, colon, rest = body.partition(":")
        if not colon or rest and rest[0] != " ":
            raise ConfigError(f"line {number}: expected 'key: value'")
        while stack[-1][0] >= indent:
            stack.pop()
        if waiting and indent > waiting[0] and waiting[1].get(waiting[2]) is None:
            child: dict = {}
            waiting[1][waiting[2]] = child
            stack.append((indent - 1, child))
        elif len(stack) == 1 and indent > 0:
            raise ConfigError(f"line {number}: unexpected indent")
        into = stack[-1][1]
        key = key.strip()
        into[key] = _scalar(rest)
        waiting = (indent, into, key) if not rest.strip() else None
        stack.append((indent, into))
    return root


def _apply(target, values: dict, at: str = "") -> None:
    """Set what the file has; zero values count as absent, an explicit false stays."""
    for f in fields(target):
        if f.name not in values or f.metadata.get("derived"):
            continue
        value, now = values[f.name], getattr(target, f.name)
        if is_dataclass(now):
            if value is not None and not isinstance(value, dict):
                raise ConfigError(f"{at}{f.name}: expected a map")
            _apply(now, value or {}, f"{at}{f.name}.")
        elif isinstance(now, bool):
            if not isinstance(value, bool):
                raise ConfigError(f"{at}{f.name}: expected true or false")
            setattr(target, f.name, value)
        elif isinstance(now, str):
            if value is not None and not isinstance(value, (str, int, float)):
                raise ConfigError(f"{at}{f.name}: expected text")
            if value not in (None, ""):
                setattr(target, f.name, str(value))
        elif value not in (None, 0, []):
            if isinstance(now, list) != isinstance(value, list) or isinstance(now, int) and not isinstance(value, int):
                raise ConfigError(f"{at}{f.name}: wrong type")
            setattr(target, f.name, type(now)(value))


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            values = parse_yaml(f.read())
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    out = Config()
    _apply(out, values)
    # A preprocessor model that the file leaves out follows the default, one it empties the planner's.
    if "llm" in values and (values["llm"] or {}).get("preprocessor_model", None) == "":
        out.llm.preprocessor_model = out.llm.planner_model
    if out.llm.api_key_env:
        out.llm.api_key = os.environ.get(out.llm.api_key_env, "")
        if not out.llm.api_key:
            raise ConfigError(f"environment variable {out.llm.api_key_env} is not set")
    return out


def problems(config: Config, need_key: bool = True) -> list[str]:
    """All range violations, not only the first."""
    out = []
    if not config.repo_path or not os.path.isdir(config.repo_path):
        out.append(f"repo_path must be an existing directory: {config.repo_path!r}")
    if need_key and not config.llm.api_key_env:
        out.append("llm.api_key_env must not be empty")
    if not 1 <= config.agent.concurrency <= 32:
        out.append(f"agent.concurrency must be between 1 and 32, not {config.agent.concurrency}")
    if config.analysis.shared_module_threshold < 1:
        out.append(f"analysis.shared_module_threshold must be at least 1, not {config.analysis.shared_module_threshold}")
    return out


def validate(config: Config, need_key: bool = True) -> None:
    found = problems(config, need_key)
    if found:
        raise ConfigError("\n".join(found))
