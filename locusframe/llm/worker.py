"""What a Python worker holds between tasks. Workers live as long as their executor, so whatever a task leaves counts for all later ones."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

from . import word_bpe


def trimmed() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean() -> None:
    """Drops tokenizers and their words, which only the step that tokenizes needs, and trims."""
    word_bpe.forget()
    trimmed()
