"""Scan settings: defaults, a JSON overlay, and the checks on it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

from strataq import dims

#: JSON key of each band, by rule.
BAND_KEYS = {"function_size": "FUNCTION_SIZE_RISK", "parameters": "PARAMETER_RISK", "complexity": "FUNCTION_COMPLEXITY_RISK", "dependency_volume": "DEPENDENCY_VOLUME_RISK", "dependency_span": "DEPENDENCY_SPAN_RISK"}


@dataclass(frozen=True)
class Config:
    bands: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(dims.BANDS))
    span_granularity: str = "package"  # or file
    module_coupling_counts: str = "modules"  # or references
    sql_methods: list[str] = field(default_factory=lambda: list(dims.SQL_METHODS))
    sql_method_suffixes: list[str] = field(default_factory=list)
    sql_receivers: list[str] = field(default_factory=lambda: list(dims.SQL_RECEIVERS))
    sql_chain_methods: list[str] = field(default_factory=lambda: list(dims.SQL_CHAIN_METHODS))
    debug_statement_exclude_dirs: list[str] = field(default_factory=lambda: list(dims.DEBUG_EXCLUDE_DIRS))
    url_allowlist_hosts: list[str] = field(default_factory=lambda: list(dims.URL_ALLOWLIST))
    exclude_dirs: list[str] = field(default_factory=lambda: list(dims.EXCLUDE_DIRS))
    disabled_rules: list[str] = field(default_factory=list)
    include_tests: bool = False
    skip_generated_files: bool = True

    def overlaid(self, given: dict[str, Any]) -> "Config":
        """These settings with the given ones over them: a band keeps the bounds that are not named, a list is
        replaced as a whole, keys that are not known are passed over."""
        bands = dict(self.bands)
        for key, rule in BAND_KEYS.items():
            band = given.get(key) or {}
            high, very = bands[rule]
            bands[rule] = (band.get("high", high), band.get("very_high", very))
        known = {f.name for f in fields(self)} - {"bands"}
        return replace(self, bands=bands, **{k: v for k, v in given.items() if k in known}).checked()

    def checked(self) -> "Config":
        if self.module_coupling_counts not in ("modules", "references"):
            raise ValueError(f"module_coupling_counts is {self.module_coupling_counts!r}; it has to be modules or references")
        if self.span_granularity not in ("package", "file"):
            raise ValueError(f"span_granularity is {self.span_granularity!r}; it has to be package or file")
        return self


def load_config(path: str | None) -> Config:
    """The defaults, overlaid with a JSON file when one is named."""
    if not path:
        return Config()
    with open(path, encoding="utf-8") as f:
        return Config().overlaid(json.load(f))


def scan_settings(flags: dict[str, Any], config_path: str, explicit: bool) -> dict[str, Any]:
    """Settings of the declaration scan: a flag before the config file before the default. The file may be absent
    unless it was named."""
    given: dict[str, Any] = {}
    if os.path.exists(config_path):
        with open(config_path, encoding="utf-8") as f:
            given = json.load(f)
    elif explicit:
        raise FileNotFoundError(config_path)
    defaults = {"roots": ["."], "skip_paths": [], "auto_import_paths": dims.AUTO_IMPORT_PATHS}
    return {k: flags.get(k) or given.get(k, v) for k, v in defaults.items()}
