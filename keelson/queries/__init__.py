"""Named queries over the test tables, each with checking SQL where SQL can say it."""

from importlib import import_module

from keelson.queries.catalog import CATALOG

MODULES = ("radar", "align", "sectors", "vision", "evaluation", "labels", "reports", "corpus", "tracks", "training", "streams", "files")

for _m in MODULES:
    import_module(f"keelson.queries.{_m}")

__all__ = ["CATALOG"]
