"""Memory that a worker has freed goes back to the system between batches.

Workers outlive tasks, and allocators keep what batches have freed; beside a heap that
does not shrink, what every stage leaves behind would add up.
"""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa


@cache
def _trim():
    """The C library's call for it, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)
