"""Topic-sized matrices on the driver."""

from __future__ import annotations

import ctypes
import functools
from pathlib import Path

import numpy as np

_SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@functools.cache
def one_blas_thread() -> None:
    """Keep numpy's bundled OpenBLAS to one thread in this process.

    Starting the JVM forks the driver, after which OpenBLAS's thread pool can wait for ever on a
    matrix large enough to use it. These matrices need no threads.
    """
    for library in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        loaded = ctypes.CDLL(str(library))
        for name in _SETTERS:
            if hasattr(loaded, name):
                getattr(loaded, name)(1)
                break
