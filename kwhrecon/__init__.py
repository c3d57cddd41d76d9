"""kwhrecon: energy-billing reconciliation as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
builder made of native Spark expressions; pipelines in ``plans`` compose
them into lazily evaluated plans that Catalyst optimises end to end.
"""

from kwhrecon.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
