"""What a Python worker keeps from task to task: the tables and found values of one step at a time.

Workers serve all steps of an application in turn. If each step left its vocabulary, automaton and cache behind, a worker
would hold those of all steps together, and an executor has as many workers as cores.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` gave for this key in this worker; what the worker holds for other keys is dropped before it is made."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what is held. For tasks of steps that hold nothing themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
