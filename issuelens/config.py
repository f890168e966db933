"""Analysis settings, passed explicitly to every operator that needs them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

# Default status and issue-type names.
RESOLVED_STATUSES = ("Resolved", "Closed", "Done", "Fixed")
DEFECT_ISSUE_TYPES = ("Bug",)
RELEASES_PER_YEAR = 52


def parse_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated names; blanks are stripped and empty entries dropped."""
    return tuple(part.strip() for part in (text or "").split(",") if part.strip())


def parse_field_map(text: str | None) -> dict[str, str]:
    """``name=id,...``; entries without '=' are ignored, the first '=' splits."""
    found = {}
    for part in (text or "").split(","):
        name, sep, field_id = part.partition("=")
        if sep:
            found[name.strip()] = field_id.strip()
    return found


@dataclass(frozen=True)
class AnalysisConfig:
    """Site settings plus the ``as_of`` clock that makes ages reproducible."""

    as_of: datetime
    resolved_statuses: tuple[str, ...] = RESOLVED_STATUSES
    defect_issue_types: tuple[str, ...] = DEFECT_ISSUE_TYPES
    critical_issue_types: tuple[str, ...] = ()
    custom_fields: Mapping[str, str] = field(default_factory=dict)
    severity_field: str = ""
    releases_per_year: int = RELEASES_PER_YEAR
    current_release: str = ""
    default_releases: tuple[str, ...] = ()

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], as_of: datetime) -> AnalysisConfig:
        """Build from a mapping of setting names to text, such as ``os.environ``."""
        current = settings.get("CURRENT_RELEASE", "")
        return cls(
            as_of=as_of,
            resolved_statuses=parse_list(settings.get("RESOLVED_STATUSES"))
            or RESOLVED_STATUSES,
            defect_issue_types=parse_list(
                settings.get("DEFECT_ISSUE_TYPES", ",".join(DEFECT_ISSUE_TYPES))
            ),
            critical_issue_types=parse_list(settings.get("CRITICAL_ISSUE_TYPES")),
            custom_fields=parse_field_map(settings.get("CUSTOM_FIELDS")),
            severity_field=settings.get("SEVERITY_FIELD", "").strip(),
            releases_per_year=int(settings.get("RELEASES_PER_YEAR", RELEASES_PER_YEAR)),
            current_release=current,
            default_releases=parse_list(settings.get("DEFAULT_RELEASES", current)),
        )
