"""skyloom: DataFrame operators for constellation-observation and corpus data."""

__version__ = "0.1.0"
