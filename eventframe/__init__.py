"""Event-structured data on Spark: lazy frames, two expression languages, binned results."""

_HOME = {"Frame": "frame", "run_graphs": "frame", "Axis": "hist", "Efficiency": "hist", "Graph": "hist", "Histogram": "hist", "Profile": "hist"}
__all__ = list(_HOME)


def __getattr__(name: str):
    """Public names load their modules when they are first used: workers import little."""
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
