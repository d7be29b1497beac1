"""What operators keep in a Python worker from task to task.

Spark hands one worker the tasks of all operators in turn, so what one keeps, and what its
arrays have left unused, would stay in memory through the stages of the next.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[str, Any] = {}
_last = [""]  # the operator whose function ran last


def begin(operator: str) -> None:
    """An operator's function starts: if another one's ran before, what that kept and what is unused goes back to the system."""
    if _last[0] == operator:
        return
    if _last[0]:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems' libraries have it
        if trim is not None:
            trim(0)
    _last[0] = operator


def kept(name: str, make: Callable[[], Any]) -> Any:
    """make()'s result, which stays until another operator begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]
