"""Format rules for identifier-like values (CON-15).

Re-aimed from configuration validators to column checks: each rule is a
regular expression a value must match in full.
"""

from __future__ import annotations

# ---- fixed values: format rules of the source configuration --------------
FORMAT_RULES: dict[str, str] = {
    "source_region": r"^[a-z]+-[a-z]+[0-9]$",
    "target_region": r"^(us|eu|ap|sa|ca|me|af)-[a-z]+-[0-9]$",
    "project_id": r"^[a-z][a-z0-9-]{4,28}[a-z0-9]$",
    "database_name": r"^[a-zA-Z][a-zA-Z0-9_]{0,63}$",
    "zone": r"^[a-z]{2}-[a-z]+-[0-9][a-z]$",
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "engine_version": r"^3\.(5|6)\.[0-9]+$",
}
MIN_ZONES = 2
# ---------------------------------------------------------------------------

# Our own rule for the CIDR lists (the source checks them with a function).
FORMAT_RULES["cidr"] = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])/([0-9]|[12][0-9]|3[0-2])$"


def rule_pattern(rule: str) -> str:
    """The regular expression of a named rule, or the argument itself."""
    return FORMAT_RULES.get(rule, rule)
