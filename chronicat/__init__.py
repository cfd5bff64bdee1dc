"""Versioned, content-addressed file catalogs as DataFrames."""

__version__ = "0.1.0"


def version_info() -> dict[str, str]:
    return {"package": __name__, "version": __version__}
