"""Calls that may fail for a moment, such as a look at a remote file system. Tasks have Spark's own retries; this is for the driver."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException

from ..contract import InputError

#: What a Spark error's trace holds if a file system or the network was at fault.
PASSING = ("java.net.", "java.io.IOException", "java.io.InterruptedIOException", "java.io.EOFException", "TimeoutException", "RemoteException")


class GaveUp(Exception):
    """Each try failed for a reason that might have passed."""


def may_pass(error: BaseException) -> bool:
    """Whether another try may do better: errors of the network and of file systems do, absent files and wrong input don't."""
    if isinstance(error, (InputError, FileNotFoundError, PermissionError, IsADirectoryError)):
        return False
    if isinstance(error, PySparkException):
        trace = f"{error}\n{getattr(error, '_stackTrace', None) or ''}"
        return any(x in trace for x in PASSING) and "FileNotFoundException" not in trace
    return isinstance(error, (OSError, GaveUp))


def pauses(first: float, longest: float) -> Iterator[float]:
    """Seconds between tries: twice as many each time, with up to a quarter more by chance."""
    while True:
        yield first * random.uniform(1, 1.25)
        first = min(2 * first, longest)


def persist_in(call: Callable, tries: int, first: float = 0.5, longest: float = 30.0, wait: Callable[[float], None] = time.sleep):
    """call(), as often as it takes, `tries` times at most."""
    for left, pause in zip(reversed(range(tries)), pauses(first, longest)):
        try:
            return call()
        except Exception as error:
            if not may_pass(error):
                raise
            if not left:
                raise GaveUp(f"{tries} tries, the last: {error}") from error
            wait(pause)
