"""Loggers of the driver, set up by GRADUS_LOG_LEVEL, _FILE, _CONSOLE and _COLORS; one for each name."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Mapping

COLORS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31, logging.CRITICAL: 35}


class Colored(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\033[{COLORS.get(record.levelno, 0)}m{super().format(record)}\033[0m"


def get_logger(name: str = "gradus", environment: Mapping[str, str] = os.environ) -> logging.Logger:
    """No file is written unless one is named; handlers are added once."""
    logger = logging.getLogger(name)
    if getattr(logger, "_gradus", False):
        return logger
    said = lambda key, default: environment.get(f"GRADUS_LOG_{key}", default)
    logger.setLevel(said("LEVEL", "INFO").upper())
    layout = "%(asctime)s %(name)s %(levelname)s %(message)s"
    if said("CONSOLE", "true").lower() == "true":
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter((Colored if said("COLORS", "false").lower() == "true" else logging.Formatter)(layout))
        logger.addHandler(handler)
    if said("FILE", ""):
        os.makedirs(os.path.dirname(os.path.abspath(said("FILE", ""))), exist_ok=True)
        handler = logging.FileHandler(said("FILE", ""))
        handler.setFormatter(logging.Formatter(layout))
        logger.addHandler(handler)
    logger.propagate, logger._gradus = False, True
    return logger
