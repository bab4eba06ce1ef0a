import json

from sparklore.cli import main, source
from sparklore.config import Config
from sparklore.kb import KnowledgeBase
from sparklore.sources import ClaudeLogs, CodexLogs, CrushLogs, default_root


def test_commands_on_no_store_fail(spark, tmp_path, capsys):
    args = ["--kb-path", str(tmp_path / "none")]
    for command in (["topics"], ["read", "x"], ["search", "x"], ["delete", "x"], ["add", "X"], ["update", "x"]):
        assert main([*args, *command], spark) == 1 and "run init first" in capsys.readouterr().err
    assert main([*args, "init"], spark) == 0 and main([*args, "topics", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.removeprefix("made\n")) == []


def test_raw_and_json(spark, tmp_path, capsys):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.add("GitHub CLI", "Unset it.", tags=["gh"], aliases=["gh"])
    kb.add("Other", "x")
    args = ["--kb-path", str(tmp_path / "kb")]
    assert main([*args, "read", "gh", "--raw"], spark) == 0
    raw = capsys.readouterr().out
    assert raw.startswith("---\ntitle: GitHub CLI\nslug: github-cli\n") and raw.endswith("---\n\nUnset it.\n")
    assert main([*args, "read", "gh"], spark) == 0 and capsys.readouterr().out == "Unset it.\n"
    assert main([*args, "topics", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [{"slug": "github-cli", "title": "GitHub CLI", "aliases": ["gh"], "tags": ["gh"]}, {"slug": "other", "title": "Other", "aliases": [], "tags": []}]


def test_inject_writes_the_block_of_this_folder(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "AGENTS.md").write_text("# Mine\n")
    assert main(["inject"], spark) == 0 and "CLAUDE.md: created" in capsys.readouterr().out
    assert (tmp_path / "AGENTS.md").read_text().startswith("# Mine\n\n<!-- sparklore:begin target=claude-code -->\n")
    assert main(["inject"], spark) == 0 and "AGENTS.md: no_change" in capsys.readouterr().out
    begin = "<!-- sparklore:begin target=claude-code -->\n"
    for name in ("AGENTS.md", "CLAUDE.md"):
        (tmp_path / name).write_text(begin * 2)
    assert main(["inject"], spark) == 1 and "duplicate" in capsys.readouterr().err and (tmp_path / "CLAUDE.md").read_text() == begin * 2


def test_usual_roots(tmp_path):
    env = {"HOME": str(tmp_path)}
    assert default_root("claude-code", env) == f"{tmp_path}/.claude/projects" and default_root("codex", env) == f"{tmp_path}/.codex/sessions"
    assert default_root("opencode", env | {"OPENCODE_CONFIG_DIR": "/o"}) == "/o" and default_root("gemini", env) == f"{tmp_path}/.gemini/tmp"
    assert isinstance(source(Config(), None), ClaudeLogs) and isinstance(source(Config(source="codex")), CodexLogs) and isinstance(source(Config(source="crush"), [str(tmp_path / "projects.json")]), CrushLogs)
