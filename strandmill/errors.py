"""Errors with the engine's codes and exit codes."""

from __future__ import annotations

import json

#: Code, exit code and meaning.
CODES = {"E000": 1, "E001": 2, "E002": 3, "E100": 10, "E101": 11, "E102": 12, "E103": 13, "E104": 14, "E105": 15, "E106": 16}


class EngineError(ValueError):
    """An input or option that a run can't go on with."""

    def __init__(self, message: str, code: str = "E000", **context: object):
        super().__init__(message + (f" ({', '.join(f'{k}={v}' for k, v in context.items())})" if context else ""))
        self.code, self.exit_code, self.context = code, CODES[code], context

    def to_json(self) -> str:
        return json.dumps({"code": self.code, "message": str(self), "exit_code": self.exit_code})


def guards(rows, checks: list, columns: list[str]) -> None:
    """Tests (violation, message, code) in one pass over rows; the first violated one raises with examples of columns."""
    from pyspark.sql import functions as F

    hit = rows.agg(*(F.max(F.when(bad, 1)).alias(f"g{i}") for i, (bad, *_) in enumerate(checks))).first()
    for (bad, message, code), seen in zip(checks, hit, strict=True):
        if seen:
            guard(rows.where(bad).select(*columns), message, code)


def guard(violations, message: str, code: str = "E100", limit: int = 5) -> None:
    """Raises with up to limit example rows if the DataFrame of violations has any."""
    found = violations.limit(limit).collect()
    if found:
        raise EngineError(message, code, examples=[r.asDict() for r in found])
