"""The log of a run, on the driver: a file of its own and what the run has made."""

from __future__ import annotations

import logging
import os
import time

from pyspark.sql import DataFrame

LOG = logging.getLogger("lectern")


def log_to(folder: str) -> str | None:
    """Logs to a new file in ``folder``, named by the time; None if the log already goes somewhere."""
    if LOG.handlers:
        return None
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, time.strftime("annotate_%Y%m%d_%H%M%S.log"))
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    return path


def log_totals(totals: DataFrame, seconds: float) -> None:
    """One line with a run's totals."""
    row = totals.first()
    LOG.info("%.1f s: %s", seconds, ", ".join(f"{k} {v}" for k, v in row.asDict().items()))
