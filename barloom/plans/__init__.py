"""Registered plans over the test tables."""


def load_all() -> None:
    """Import every plan module, which fills the registry."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"barloom.plans.{name}")


MODULES = ["indicators", "features", "signals", "statistics", "portfolio", "sources", "forecast", "text", "streams"]
