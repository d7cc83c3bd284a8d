"""linkflow: link-graph and request analytics on Spark.

Everything is expressed with the DataFrame API, Structured Streaming and
``pyspark.ml``; see README.md for the module map.
"""

from linkflow.session import checkpoint_root, local_session, scratch_path

__all__ = ["checkpoint_root", "local_session", "scratch_path"]
