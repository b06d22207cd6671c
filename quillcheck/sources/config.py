"""Project configuration in TOML, passed on explicitly."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from quillcheck.operators.decide import DecisionRules

#: Headings under which the tables are looked for by default.
DEFAULT_HEADINGS = {"p_table": "p-value", "beta_table": "beta", "wilcoxon_table": "Wilcoxon"}


@dataclass(frozen=True)
class AuditConfig:
    """Everything that a run is told; paths are absolute."""

    project: str = "project"
    manuscripts: tuple[str, ...] = ()
    references: str | None = None
    stats: str | None = None
    summary_stats: str | None = None
    library: str | None = None
    reports_dir: str = "reports"
    headings: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_HEADINGS))
    summary_headings: dict[str, str] = field(default_factory=dict)
    summary_labels: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    rules: DecisionRules = field(default_factory=DecisionRules)
    scorer: str = "codex"
    scorer_argv: tuple[str, ...] = ()
    scorer_timeout: int = 120


def load_config(path: str | Path) -> AuditConfig:
    """A configuration file; relative paths are relative to it, headings extend the defaults."""
    path = Path(path)
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    base = path.resolve().parent
    at = lambda p: None if not p else str((base / p).resolve())
    project, stats, lib, llm = (raw.get(k, {}) for k in ("project", "stats", "library", "llm"))
    keywords = tuple((dv, k) for dv, ks in stats.get("dv_keywords", {}).items() for k in ks)
    defaults = DecisionRules()
    rules = DecisionRules(
        dv_keywords=keywords, modifier_keywords=tuple(stats.get("modifier_keywords", defaults.modifier_keywords)), condition_labels=tuple(stats.get("condition_labels", ())),
        percent_dvs=tuple(stats.get("percent_dvs", ())), n_contexts={k: int(v) for k, v in stats.get("n", {}).items()}, alpha_values={k: float(v) for k, v in stats.get("alpha", {}).items()},
    )
    specs = project.get("manuscripts", [])
    return AuditConfig(
        project=project.get("name", "project"), manuscripts=tuple(str(base / s) for s in ([specs] if isinstance(specs, str) else specs)), references=at(project.get("references")), stats=at(project.get("stats")),
        summary_stats=at(project.get("summary_stats")), library=at(lib.get("root")), reports_dir=at(project.get("reports_dir", "reports")), headings=DEFAULT_HEADINGS | stats.get("headings", {}),
        summary_headings=dict(stats.get("summary_sections", {})), summary_labels=tuple(stats.get("summary_labels", ())), aliases=dict(stats.get("dv_aliases", {})), rules=rules, scorer=str(llm.get("provider", "codex")), scorer_argv=tuple(str(a) for a in llm.get("argv", ())), scorer_timeout=int(llm.get("timeout", 120)),
    )
