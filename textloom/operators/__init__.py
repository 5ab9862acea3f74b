"""DataFrame -> DataFrame stages, each usable with ``df.transform``."""
