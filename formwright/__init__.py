"""Typed tables from ragged JSON, as Spark plans."""

__version__ = "0.1.0"

_HOME = {"run": "operators.run", "Feed": "operators.run", "Result": "operators.run", "Spec": "plans.spec", "Column": "plans.spec", "Drift": "plans.spec", "Input": "plans.spec", "Output": "plans.spec", "Shaped": "operators.shape", "Table": "sources.table", "build": "session"}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Found when first asked for: a Python worker that needs one module does not load all."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
