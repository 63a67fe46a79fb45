"""Version, status codes, argument checks and logging."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable
from enum import IntEnum

VERSION = "0.2.0"
#: The k that flat and coded searches are clamped to.
MAX_K = 64


class Status(IntEnum):
    OK = 0
    NULL_ARGUMENT = 1
    INVALID_ARGUMENT = 2
    OUT_OF_MEMORY = 3
    NOT_READY = 4
    INTERNAL = 5


def status_text(code: int) -> str:
    try:
        return Status(code).name.lower().replace("_", " ")
    except ValueError:
        return "unknown status"


class VexelError(ValueError):
    """A failure with a status code."""

    def __init__(self, code: Status, message: str):
        super().__init__(f"{status_text(code)}: {message}")
        self.code = code

    def __reduce__(self):
        return _remade, (int(self.code), str(self))


def _remade(code: int, text: str) -> VexelError:
    return VexelError(Status(code), text.split(": ", 1)[-1])


def require(good: bool, message: str, code: Status = Status.INVALID_ARGUMENT) -> None:
    if not good:
        raise VexelError(code, message)


def check_build(vectors, **positive: int) -> None:
    """A table (code 1 if missing) and sizes that must be positive (code 2)."""
    require(vectors is not None, "vectors", Status.NULL_ARGUMENT)
    for name, value in positive.items():
        require(value is not None, name, Status.NULL_ARGUMENT)
        require(value > 0, f"{name} must be positive, not {value}")


def check_search(queries, k: int, nprobe: int = 1, rerank: int = 0) -> None:
    """The strict checks; searches themselves clamp instead."""
    require(queries is not None, "queries", Status.NULL_ARGUMENT)
    require(k >= 1, f"k must be at least 1, not {k}")
    require(nprobe >= 1, f"nprobe must be at least 1, not {nprobe}")
    require(rerank >= 0, f"rerank must not be negative, not {rerank}")


log = logging.getLogger("vexel")
_default = logging.StreamHandler(sys.stderr)
log.addHandler(_default)
log.setLevel(logging.WARNING)


class _Handler(logging.Handler):
    def __init__(self, call: Callable[[int, str], None]):
        super().__init__()
        self.call = call

    def emit(self, record: logging.LogRecord) -> None:
        self.call(record.levelno, record.getMessage())


def set_log_handler(call: Callable[[int, str], None] | None) -> None:
    """Messages go to `call(level, text)`, or to stderr again with None."""
    for h in list(log.handlers):
        log.removeHandler(h)
    log.addHandler(_default if call is None else _Handler(call))


def set_log_level(level: int) -> None:
    """Messages below the level are dropped before they are put together."""
    log.setLevel(level)
