"""Which rules and columns a run may touch."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

RULES = (
    "format_name", "validate_contact", "validate_mgnrega", "infer_gender", "infer_category", "deduplicate",
    "auto_correct", "auto_correct_gender", "auto_correct_category", "spell_check",
)


class Mode(str, Enum):
    GLOBAL = "GLOBAL"
    SELECTIVE = "SELECTIVE"
    ADVISORY = "ADVISORY"


@dataclass(frozen=True)
class Context:
    """GLOBAL runs everything; SELECTIVE only what is listed; ADVISORY logs and changes nothing."""

    mode: Mode = Mode.GLOBAL
    columns: frozenset[str] | None = None
    rules: frozenset[str] | None = None
    log_only: bool = field(default=False)

    @property
    def dry_run(self) -> bool:
        return self.log_only or self.mode is Mode.ADVISORY

    def _allows(self, chosen: frozenset[str] | None, name: str) -> bool:
        if self.mode is Mode.GLOBAL:
            return True
        if chosen is None:
            return self.mode is Mode.ADVISORY
        return name in chosen

    def allow_rule(self, name: str) -> bool:
        return self._allows(self.rules, name)

    def allow_column(self, name: str) -> bool:
        return self._allows(self.columns, name)

    @classmethod
    def selective(cls, columns, rules) -> Context:
        return cls(Mode.SELECTIVE, frozenset(columns), frozenset(rules))

    @classmethod
    def advisory(cls, columns=None, rules=None) -> Context:
        return cls(
            Mode.ADVISORY,
            frozenset(columns) if columns is not None else None,
            frozenset(rules) if rules is not None else None,
        )
