"""The one error of the language: a code, a message, the text and a byte position."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, code: str, message: str, expr: str = "", pos: int | None = None):
        super().__init__(f"{code}: {message}" + (f" at byte {pos}" if pos is not None else ""))
        self.code, self.message, self.expr, self.pos = code, message, expr, pos

    def as_dict(self) -> dict:
        out = {"code": self.code, "message": self.message, "expr": self.expr}
        return out if self.pos is None else out | {"pos": self.pos}
