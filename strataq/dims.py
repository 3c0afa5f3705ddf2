"""Dimension tables of the quality model.

FIXED VALUES: everything in this module has to equal the model's published
figures and the documented defaults; it is data, not logic.
"""

from __future__ import annotations

#: Rules in report order: the standard ones, then the gap rules.
RULES = [
    "CYCLIC_REFERENCE",
    "FUNCTION_SIZE_RISK",
    "PARAMETER_RISK",
    "FUNCTION_COMPLEXITY_RISK",
    "DEPENDENCY_VOLUME_RISK",
    "DEPENDENCY_SPAN_RISK",
    "HARDCODED_URL",
    "HARDCODED_PATH",
    "COPYRIGHT_OR_LICENSE_NOTICE",
    "SQL_IN_LOOP",
    "STRING_CONCAT_IN_LOOP",
    "NESTED_LOOP",
    "EMPTY_BRANCH",
    "SWITCH_WITHOUT_DEFAULT",
    "DEBUG_STATEMENT",
    "COMMENTED_OUT_CODE",
    "UNFINISHED_WORK",
    "SUPPRESSED_WARNING",
    "MISSING_DOC_COMMENT",
]
REVIEW_RULES = ["SQL_IN_LOOP", "NESTED_LOOP", "SWITCH_WITHOUT_DEFAULT"]

#: rule: (above which a value is high, very high)
BANDS = {
    "FUNCTION_SIZE_RISK": (200, 500),
    "PARAMETER_RISK": (4, 6),
    "FUNCTION_COMPLEXITY_RISK": (20, 40),
    "DEPENDENCY_VOLUME_RISK": (110, 200),
    "DEPENDENCY_SPAN_RISK": (23, 33),
}

#: property: (column, [(category, least, most)], [(threshold, inclusive, cap %)])
UNBOUNDED = 2**31 - 1
UNIT_PROPERTIES = {
    "unit_size": ("loc", [("low", 1, 15), ("moderate", 16, 30), ("high", 31, 60), ("very high", 61, UNBOUNDED)], [(15, False, 47.1), (30, False, 23.1), (60, False, 8.3)]),
    "unit_complexity": ("mccabe", [("low", 1, 5), ("moderate", 6, 10), ("high", 11, 25), ("very high", 26, UNBOUNDED)], [(5, False, 20.2), (10, False, 7.3), (25, False, 1.1)]),
    "unit_interfacing": ("params", [("low", 0, 2), ("moderate", 3, 4), ("high", 5, 6), ("very high", 7, UNBOUNDED)], [(3, True, 15.0), (5, True, 3.3), (7, True, 0.9)]),
}
MODULE_PROPERTIES = {
    "module_coupling": ("incoming", [("low", 0, 10), ("moderate", 11, 20), ("high", 21, 50), ("very high", 51, UNBOUNDED)], [(10, False, 10.0), (20, False, 5.6), (50, False, 1.9)]),
}
AT_CAP_MARGIN = 0.05
DUPLICATION_LINES, DUPLICATION_CAP = 6, 5.6
INDEPENDENCE_FLOOR = 93.7

#: Lines of code in BUDGET_YEARS person-years.
BUDGET_YEARS = 3.9
LINES_PER_BUDGET = {"C++": 32000, "C#": 39000, "Java": 35100, "JavaScript": 36300, "Python": 25000, "Ruby": 24600, "TypeScript": 31600}

#: property: (column, most that is low risk)
DELTA_PROPERTIES = {"unit_size": ("loc", 15), "unit_complexity": ("mccabe", 5), "unit_interfacing": ("params", 2)}

MODULE_METRICS = ["coupling", "duplication"]

SQL_METHODS = ["Find", "First", "Last", "Take", "Scan", "Pluck", "Count", "Create", "CreateInBatches", "Save", "Update", "Updates", "Delete", "FirstOrCreate", "FirstOrInit", "Exec", "ExecContext", "Query", "QueryContext", "QueryRow", "QueryRowContext", "Raw"]
SQL_RECEIVERS = ["db", "tx", "gdb", "conn", "pool"]
SQL_CHAIN_METHODS = ["Where", "Or", "Not", "Table", "Select", "Omit", "Distinct", "Joins", "Preload", "Order", "Limit", "Offset", "Group", "Having", "Model", "Clauses", "Unscoped", "WithContext", "Session", "Debug", "Attrs", "Assign", "InnerJoins", "MapColumn"]
EXCLUDE_DIRS = ["gen", "migrations", "seed", ".disabled-gen", "vendor", "testdata"]
DEBUG_EXCLUDE_DIRS = ["cmd"]
SKIP_DIRS = ["node_modules", ".nuxt", ".output", "dist", "coverage", "generated", "playwright-report", "test-results", ".git"]
URL_ALLOWLIST = ["w3.org", "rfc-editor.org", "datatracker.ietf.org"]
RESERVED_TLDS = ["test", "example", "invalid", "localhost"]
RESERVED_DOMAINS = ["example.com", "example.net", "example.org"]
FILESYSTEM_ROOTS = ["etc", "var", "tmp", "usr", "opt", "home", "root", "proc", "sys", "dev", "mnt", "srv", "app", "run"]

#: Regular expressions over text, in Java's syntax; words end where an ASCII letter, digit or _ does not go on.
URL_PATTERN = r"""(?<![0-9A-Za-z_])[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s"'<>)\\]+"""
WINDOWS_PATH = r"^[A-Za-z]:[\\/]"
HOME_PATH = r"^~[\\/]"
RELATIVE_PATH = r"^\.{0,2}/?[0-9A-Za-z_.\-]+(/[0-9A-Za-z_.\-]+)+\.[A-Za-z][A-Za-z0-9]{0,7}$"
MIME_TYPE = r"^(application|audio|font|image|message|model|multipart|text|video)/"
NOTICE = r"(?i)(?<![0-9A-Za-z_])copyright(?![0-9A-Za-z_])\s*(\(c\)|©|\d{4})|(?<![0-9A-Za-z_])SPDX-License-Identifier(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])all rights reserved(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])licensed under (the )?(MIT|Apache|BSD|GNU|GPL|LGPL|MPL|ISC)(?![0-9A-Za-z_])"
UNFINISHED = r"(?<![0-9A-Za-z_])(TODO|FIXME|XXX|HACK)(?![0-9A-Za-z_])"
SUPPRESSION = r"^//\s*(nolint|lint:ignore)(?![0-9A-Za-z_])"
GENERATED_MARKER = r"^// Code generated .* DO NOT EDIT\.$"
GENERATED_WORDS = "// Code generated "

# Duplicate declarations
MIN_VALUE_LENGTH, MIN_FIELDS, MIN_PACKAGES = 4, 4, 4
AUTO_IMPORT_PATHS = [r"(?:^|/)(?:composables|utils)/[^/]+$"]
LEVELS = [(7, "HIGH"), (4, "MEDIUM")]
