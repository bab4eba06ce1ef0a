"""Readers and writers of session logs and of the topic store."""

import os
from pathlib import Path

from .logs import ClaudeLogs, CodexLogs, GeminiLogs
from .sqlite import CrushLogs, OpenCodeLogs

#: Readers by provider name; each has ``sessions(spark)`` and ``turns(spark, sessions)``.
PROVIDERS = {"claude-code": ClaudeLogs, "codex": CodexLogs, "gemini": GeminiLogs, "crush": CrushLogs, "opencode": OpenCodeLogs}

#: Where each kind of log is kept, below the user's home; of the last kind the settings' folder.
ROOTS = {"claude-code": ".claude/projects", "codex": ".codex/sessions", "gemini": ".gemini/tmp", "crush": ".local/share/crush/projects.json", "opencode": ".config/opencode"}


def default_root(provider: str, env: dict | None = None) -> str:
    """The provider's usual root; ``OPENCODE_CONFIG_DIR`` names another settings' folder."""
    env = os.environ if env is None else env
    return (provider == "opencode" and env.get("OPENCODE_CONFIG_DIR")) or str(Path(env.get("HOME") or "~").expanduser() / ROOTS[provider])
