"""gritsieve: typing, cleaning, profiling and distribution analysis of tables on Spark."""

__version__ = "0.1.0"
