"""Errors with a stable code, and what to do about them."""

from __future__ import annotations

#: First letter of a code: what kind of error it is.
CATEGORIES = {"C": "argument", "K": "contract", "D": "data", "F": "format", "I": "integrity", "R": "resume", "P": "pack", "S": "size", "M": "migration", "X": "internal"}
SKIP_REASONS = {
    "D201": "the text is not valid UTF-8", "D202": "a token id doesn't fit the item type", "D203": "the document has no tokens",
    "D204": "the tokenizer failed", "D206": "the reader could not read the document",
}


class EngineError(Exception):
    """what happened, why, and how to mend it."""

    def __init__(self, code: str, what: str, why: str = "", fix: str = ""):
        super().__init__(" ".join(x for x in (f"[{code}] {what}", why and f"Cause: {why}", fix and f"Fix: {fix}") if x))
        self.code, self.what, self.why, self.fix = code, what, why, fix
        self.category = CATEGORIES[code[0]]


def integer(value: object, name: str, least: int, most: int | None = None) -> int:
    """An integer argument in range; bools, floats and strings are refused."""
    import operator

    if isinstance(value, bool):
        raise EngineError("C301", f"{name} must be an integer, not a bool")
    try:
        n = operator.index(value)  # type: ignore[arg-type]
    except TypeError:
        raise EngineError("C301", f"{name} must be an integer, not {type(value).__name__}") from None
    if n < least or (most is not None and n > most):
        raise EngineError("C302", f"{name} is {n}", f"it must be {least} or more" + (f" and at most {most}" if most is not None else ""))
    return n
