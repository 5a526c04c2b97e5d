"""densel — density-based selection, weighting and evaluation of labelled text on Spark.

Every public operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``) whose heavy work stays inside Spark: joins, grouped aggregates,
windows and Arrow-batched NumPy blocks for the distance kernel.
"""

from densel.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
