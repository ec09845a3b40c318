"""DataFrame -> DataFrame operators; compose them with ``DataFrame.transform``."""
