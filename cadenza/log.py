"""Console messages on five levels, by the standard library."""

from __future__ import annotations

import logging
import sys

SUCCESS = 25
logging.addLevelName(SUCCESS, "SUCCESS")


class Console(logging.LoggerAdapter):
    """info, success, warning, debug and error; messages may be any value."""

    def success(self, message) -> None:
        self.log(SUCCESS, message)


class _Streams(logging.Handler):
    """Errors go to stderr, all else to stdout, wherever those point now."""

    def emit(self, record: logging.LogRecord) -> None:
        print(self.format(record), file=sys.stderr if record.levelno >= logging.ERROR else sys.stdout)


def console(name: str, level: int = logging.INFO) -> Console:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = _Streams()
        handler.setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level)
    return Console(log, {})
