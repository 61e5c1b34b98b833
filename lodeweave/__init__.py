"""Part of lodeweave, an analytics engine for code graphs and corpora on Spark."""

__version__ = "0.2.0"
