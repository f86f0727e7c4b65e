"""Objects that a Python worker keeps from task to task, such as a loaded model."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

#: Functions of this package travel to the workers by value and find fresh module variables there in every task; the table
#: of modules is what stays as long as the worker does.
_STORE = "linewright_worker_store"


def kept_per_worker(kind: str, name: str, make: Callable[[], Any]) -> Any:
    """The object of that name, made by the first task of this worker that asks. Another name replaces the kind's last one."""
    kept = sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__
    if kind not in kept or kept[kind][0] != name:
        kept[kind] = (name, make())
    return kept[kind][1]
