"""Rules from elsewhere: Python modules that define RULE or RULES."""

from __future__ import annotations

import importlib.util
import warnings
from pathlib import Path

from palisade.rules.model import Rule


def load_plugins(paths) -> tuple[Rule, ...]:
    """The rules of the modules at paths; one that cannot be loaded is told of and left out."""
    out: list[Rule] = []
    for path in paths:
        try:
            spec = importlib.util.spec_from_file_location(f"palisade_plugin_{Path(path).stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            found = getattr(module, "RULES", None) or [module.RULE]
            out += [r for r in found if isinstance(r, Rule)]
        except Exception as err:  # a plugin may fail in any way
            warnings.warn(f"plugin {path}: {err}", stacklevel=2)
    return tuple(out)
