"""Topic analytics over text tables and text streams, expressed as Spark DataFrames."""

from topicloom.params import TopicParams

__all__ = ["TopicParams"]
