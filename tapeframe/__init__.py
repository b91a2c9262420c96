"""tapeframe: market-microstructure analytics as DataFrame operators on Spark."""

from tapeframe.session import build_session

__all__ = ["build_session"]
