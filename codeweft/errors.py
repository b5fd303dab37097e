"""Error contract: six-digit codes in families."""

from __future__ import annotations

# Codes that callers test for.
REPO_ID_EMPTY = 100001
CONTEXT_INPUT_EMPTY = 100005
PATH_ESCAPE = 100007
SNIPPET_RANGE = 100009
BAD_PATTERN = 100011
BAD_JSON = 100012


class EngineError(ValueError):
    """A refused request; ``code`` says why."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
