"""Table movement and shaping on Spark DataFrames."""

from drayline.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
