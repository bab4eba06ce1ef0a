"""Settings: what a pass takes, how strictly learnings are matched, which model is asked."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from enum import StrEnum
from pathlib import Path


class Regime(StrEnum):
    AGGRESSIVE = "aggressive"
    BALANCED = "balanced"
    CONSERVATIVE = "conservative"

    @classmethod
    def parse(cls, text: str) -> Regime:
        try:
            return cls(text.strip().lower())
        except ValueError:
            raise ValueError(f"unknown regime {text!r}; one of {', '.join(cls)}") from None


class TitleMode(StrEnum):
    EXACT = "exact"
    FUZZY = "fuzzy"
    CONTAINS = "contains"


@dataclass(frozen=True)
class DedupePolicy:
    regime: Regime = Regime.BALANCED
    coverage_threshold: float = 0.8
    tag_overlap_minimum: int = 2
    require_slug_affinity: bool = True
    title_mode: TitleMode = TitleMode.CONTAINS
    title_similarity: float = 0.5
    tag_jaccard_threshold: float = 0.5

    @classmethod
    def preset(cls, regime: Regime | str) -> DedupePolicy:
        regime = Regime.parse(regime)
        if regime is Regime.AGGRESSIVE:
            return cls(regime, 0.95, 3, True, TitleMode.EXACT, 0.5, 1.0)
        if regime is Regime.CONSERVATIVE:
            return cls(regime, 0.6, 1, False, TitleMode.FUZZY, 0.5, 0.35)
        return cls()

    def with_overrides(self, coverage_threshold: float | None = None, tag_overlap_minimum: int | None = None, require_slug_affinity: bool | None = None, title_match_mode: str | None = None) -> DedupePolicy:
        """With single knobs set; a value out of range is an error."""
        if coverage_threshold is not None and not 0 <= coverage_threshold <= 1:
            raise ValueError("coverage_threshold must lie in [0, 1]")
        if tag_overlap_minimum is not None and tag_overlap_minimum < 1:
            raise ValueError("tag_overlap_minimum must be at least 1")
        mode = None if title_match_mode is None else TitleMode(title_match_mode.strip().lower())
        given = {"coverage_threshold": coverage_threshold, "tag_overlap_minimum": tag_overlap_minimum, "require_slug_affinity": require_slug_affinity, "title_mode": mode}
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def summary(self) -> str:
        mode = f"fuzzy({self.title_similarity:.2f})" if self.title_mode is TitleMode.FUZZY else str(self.title_mode)
        affinity = "+slug" if self.require_slug_affinity else ""
        return f"{self.regime} (title={mode}, tags>={self.tag_overlap_minimum}{affinity}, coverage>={self.coverage_threshold:.2f})"


@dataclass(frozen=True)
class PatternConfig:
    similarity_threshold: float = 0.4
    min_occurrences: int = 3
    max_clusters_per_pass: int = 5
    enabled: bool = True


@dataclass(frozen=True)
class LoopConfig:
    context_limit: int = 20
    poll_interval_secs: int = 300
    confidence_threshold: float = 0.7
    max_transcript_len: int = 30_000
    patterns: PatternConfig = field(default_factory=PatternConfig)


#: The model taken of a provider, and the environment's name for its key, in the order they are looked for.
MODELS = {"anthropic": ("claude-sonnet-4-6", "ANTHROPIC_API_KEY"), "openai": ("gpt-4o-mini", "OPENAI_API_KEY"), "gemini": ("gemini-2.0-flash", "GEMINI_API_KEY")}


@dataclass(frozen=True)
class ModelConfig:
    """Which model the caller's client asks; see ``resolved`` for what is not set."""

    provider: str = ""
    model: str = ""
    max_tokens: int = 4096

    def resolved(self, env: dict | None = None) -> ModelConfig:
        """With the provider whose key ``env`` holds where none is set, and that provider's usual model."""
        env = os.environ if env is None else env
        provider = self.provider.strip().lower() or next((p for p, (_, key) in MODELS.items() if env.get(key)), "")
        if provider and provider not in MODELS:
            raise ValueError(f"unknown provider {provider!r}; one of {', '.join(MODELS)}")
        return replace(self, provider=provider, model=self.model or (MODELS[provider][0] if provider else ""))

    def key(self, env: dict | None = None) -> str:
        """The provider's key; an error where it is not set."""
        env, provider = os.environ if env is None else env, self.resolved(env).provider
        value = env.get(MODELS[provider][1], "") if provider else ""
        if not value:
            raise ValueError(f"{MODELS[provider][1] if provider else 'a key of ' + ', '.join(MODELS)} is not set")
        return value


@dataclass(frozen=True)
class Config:
    kb_path: str = "topics"
    source: str = "claude-code"
    loop: LoopConfig = field(default_factory=LoopConfig)
    llm: ModelConfig = field(default_factory=ModelConfig)
    dedupe: DedupePolicy = field(default_factory=DedupePolicy)

    @classmethod
    def load(cls, path: str | None = None, env: dict | None = None, **given) -> Config:
        """Arguments win over the environment, that over the file, that over defaults."""
        env = os.environ if env is None else env
        out = cls()
        if path and Path(path).expanduser().exists():
            out = cls.from_dict(tomllib.loads(Path(path).expanduser().read_text()))
        out = out.with_env(env)
        named = {k: v for k, v in given.items() if k in ("kb_path", "source") and v}
        out = replace(out, **named)
        return replace(out, source=provider_name(out.source), kb_path=os.path.expanduser(out.kb_path))

    def with_env(self, env: dict) -> Config:
        """With what ``SPARKLORE_*`` variables set: the settings' own names, upper case, those of the parts after the part's."""

        def over(part, prefix: str):
            changes = {}
            for f in fields(part):
                name, held = f"{prefix}{f.name.upper()}", getattr(part, f.name)
                if hasattr(held, "__dataclass_fields__"):
                    changes[f.name] = over(held, f"{name}_") if f.name != "dedupe" else held
                elif env.get(name):
                    text = env[name]
                    changes[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if isinstance(held, bool) else type(held)(text)
            return replace(part, **changes)

        out = over(self, "SPARKLORE_")
        if regime := env.get("SPARKLORE_REGIME"):
            out = replace(out, dedupe=DedupePolicy.preset(regime))
        return out

    def to_toml(self) -> str:
        """The settings as a file that ``load`` reads back."""
        rules = self.dedupe
        tables = {
            "": {"kb_path": self.kb_path, "source": self.source},
            "loop": {f.name: getattr(self.loop, f.name) for f in fields(self.loop) if f.name != "patterns"},
            "loop.patterns": {f.name: getattr(self.loop.patterns, f.name) for f in fields(self.loop.patterns)},
            "llm": {f.name: getattr(self.llm, f.name) for f in fields(self.llm)},
            "dedupe": {"regime": rules.regime, "coverage_threshold": rules.coverage_threshold, "tag_overlap_minimum": rules.tag_overlap_minimum, "require_slug_affinity": rules.require_slug_affinity, "title_match_mode": rules.title_mode},
        }
        value = lambda v: json.dumps(str(v) if isinstance(v, str) else v)  # noqa: E731  a TOML value of these kinds is one of JSON
        return "\n".join("\n".join([*([f"[{name}]"] if name else []), *(f"{k} = {value(v)}" for k, v in held.items()), ""]) for name, held in tables.items())

    def write(self, path: str) -> None:
        """Written beside its place and moved there, so that no half of a file is ever read."""
        at = Path(path).expanduser()
        at.parent.mkdir(parents=True, exist_ok=True)
        made = at.with_name(at.name + ".tmp")
        made.write_text(self.to_toml())
        made.replace(at)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        def only(kind, values):
            known = {f.name for f in fields(kind)}
            return {k: v for k, v in values.items() if k in known}

        loop = dict(data.get("loop", {}))
        patterns = PatternConfig(**only(PatternConfig, loop.pop("patterns", {})))
        rules = dict(data.get("dedupe", {}))
        policy = DedupePolicy.preset(rules.pop("regime", "balanced")).with_overrides(**rules)
        top = {k: v for k, v in data.items() if k in ("kb_path", "source")}
        return cls(**top, loop=LoopConfig(**only(LoopConfig, loop), patterns=patterns), llm=ModelConfig(**only(ModelConfig, data.get("llm", {}))), dedupe=policy)


def provider_name(name: str | None) -> str:
    """The known provider of that name; the default one for any other."""
    name = (name or "").strip().lower()
    return name if name in ("claude-code", "codex", "gemini", "crush", "opencode") else "claude-code"
