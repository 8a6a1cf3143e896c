"""Error classes of a file's outcome (L5, T8) and errors carried as data.

User code raises ``SkipFileError`` to leave a file out, ``RetryableError`` for what another attempt may mend, and
anything else for what none can.  A frame with the column ``_fail`` says which files fail and why: ``kind: message``
in any row of a file fails that file, and the files beside it go on.
"""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

FAIL = "_fail"
MESSAGE_CHARS = 300


class RetryableError(RuntimeError):
    """Another attempt may succeed: a time limit, a lost connection, a locked file."""


class FatalError(RuntimeError):
    """No attempt can succeed: wrong data, wrong settings, wrong user code."""


class SkipFileError(RuntimeError):
    """The file is left out: it is empty, of no use, or loaded already."""


_RETRYABLE = (RetryableError, TimeoutError, ConnectionError, BlockingIOError, InterruptedError)
_RETRYABLE_NAMES = {c.__name__ for c in _RETRYABLE} | {c.__name__ for c in ConnectionError.__subclasses__()}
# what an executor or the cluster suffers is no file's fault
_INFRASTRUCTURE = ("ExecutorLostFailure", "OutOfMemoryError", "No space left on device", "FetchFailed",
                   "SparkContext was shut down", "Python worker exited unexpectedly", "cancelled")


def error_kind(exc: BaseException) -> str:
    """``skip``, ``retryable`` or ``fatal``, by the class alone; what is not known as one of the first two is fatal."""
    if isinstance(exc, SkipFileError):
        return "skip"
    return "retryable" if isinstance(exc, _RETRYABLE) else "fatal"


def raised_kind(text: str) -> str:
    """``error_kind`` of an error raised in a task, from the class that ends its trace; ``infrastructure``
    where no file is to blame."""
    if any(w in text for w in _INFRASTRUCTURE):
        return "infrastructure"
    told = re.search(r"\[USER_RAISED_EXCEPTION\] (skip|retryable|fatal): ", text)  # F.raise_error("kind: message")
    if told:
        return told.group(1)
    if "Traceback (most recent call last)" in text:
        trace = text[text.rindex("Traceback (most recent call last)"):]
        for line in trace.splitlines()[1:]:
            m = re.match(r"([A-Za-z_][\w.]*)(:|$)", line)
            if m:
                name = m.group(1).rsplit(".", 1)[-1]
                return "skip" if name == "SkipFileError" else "retryable" if name in _RETRYABLE_NAMES else "fatal"
    return "fatal"


def failure(exc: BaseException) -> str:
    """An error as data."""
    return f"{error_kind(exc)}: {type(exc).__name__}: {exc}"[:MESSAGE_CHARS]


def fail_when(condition: Column, message: str, kind: str = "fatal") -> Column:
    """The column ``_fail`` of rows whose file fails, in DataFrame expressions."""
    if kind not in ("fatal", "retryable", "skip"):
        raise ValueError(f"no kind of error: {kind}")
    return F.when(condition, F.lit(f"{kind}: {message}"[:MESSAGE_CHARS]))


def of_kind(kind: str, message: str) -> RuntimeError:
    """The error that says as an exception what ``kind: message`` says as data."""
    return {"skip": SkipFileError, "retryable": RetryableError}.get(kind, FatalError)(message)


@contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """``RetryableError`` in code that runs longer (in a process's main thread, as user code in tasks does)."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise RetryableError(f"user code ran longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
