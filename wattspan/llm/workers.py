"""What a Python worker keeps between tasks.

Workers are reused, also by other operators. A memo that one operator left would stand beside the next one's
for ever, so a worker keeps the memos of one operator at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None] = lambda: None) -> None:
    """Say that this worker now works for ``name``; what others hold is released and given back to the system."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = release
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
