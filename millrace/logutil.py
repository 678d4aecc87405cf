"""Logging with a TRACE level below DEBUG; Info by default, to stderr, with the place of the call."""

from __future__ import annotations

import logging

TRACE = 5
logging.addLevelName(TRACE, "TRACE")


def logger(name: str = "millrace", level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(filename)s:%(lineno)d %(message)s"))
        log.addHandler(handler)
        log.setLevel(level)
        log.propagate = False
    return log
