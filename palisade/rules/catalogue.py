"""All rules in output order, and their selection."""

from __future__ import annotations

from palisade.rules import code, prompt_text
from palisade.rules.model import CONFIDENCE_ORDER, Rule

FAMILIES: dict[str, tuple[Rule, ...]] = {
    "injection": prompt_text.INJECTION, "exfiltration": prompt_text.EXFILTRATION, "jailbreak": prompt_text.JAILBREAK,
    "tools": prompt_text.TOOLS, "commands": code.COMMANDS, "retrieval": prompt_text.RETRIEVAL, "encoding": prompt_text.ENCODING,
    "output": code.OUTPUT, "multimodal": code.MULTIMODAL, "skills": code.SKILLS, "agents": code.AGENTS, "mcp": code.MCP,
    "supply": code.SUPPLY, "load": code.LOAD, "persistence": code.PERSISTENCE, "taint": code.TAINT,
}
RULES = tuple(r for family in FAMILIES.values() for r in family)

#: Names of rule bundles.
PRESETS = {
    "owasp-llm-top10": ("INJ-*", "JBK-*", "EXF-*", "OUT-*", "RAG-*", "TOOL-*", "SCH-*", "DOS-*", "VIS-*"),
    "injection": ("INJ-*", "RAG-*", "ENC-*"),
    "jailbreak": ("JBK-*",),
    "exfiltration": ("EXF-*",),
    "agentic": ("AGT-*", "MCP-*", "TOOL-*"),
    "mcp": ("MCP-*",),
    "supply-chain": ("SCH-*",),
    "prompt-files": ("INJ-*", "JBK-*", "EXF-*", "ENC-*", "SKL-*"),
}


def named(rule_id: str, pattern: str) -> bool:
    return rule_id.startswith(pattern[:-1]) if pattern.endswith("*") else rule_id == pattern


def preset_patterns(names: str) -> list[str]:
    out: dict[str, None] = {}
    for name in filter(None, names.lower().replace(",", " ").split()):
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
        out.update(dict.fromkeys(PRESETS[name]))
    return list(out)


def select(include=(), exclude=(), min_confidence: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules to plan: exclusion wins, then a non-empty inclusion, then the least confidence (an unknown one passes all)."""
    least = CONFIDENCE_ORDER.index(min_confidence) if min_confidence in CONFIDENCE_ORDER else -1
    return tuple(
        r for r in rules
        if not any(named(r.id, p) for p in exclude) and (not include or any(named(r.id, p) for p in include)) and CONFIDENCE_ORDER.index(r.confidence) >= least
    )
