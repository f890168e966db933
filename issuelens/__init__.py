"""Issue-quality analytics on Spark DataFrames."""

from issuelens.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
