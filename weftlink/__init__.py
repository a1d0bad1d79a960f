"""weftlink: entity linking and text analytics as Spark DataFrame plans."""

from weftlink.config import Params

__all__ = ["Params"]
