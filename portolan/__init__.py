"""Bilateral flow analytics as Spark jobs.

A flow row says that in period ``t`` origin ``i`` sent product ``k`` worth ``v``
(thousand USD) and weighing ``q`` (metric tons) to destination ``j``.  Every
operator is a function from DataFrames to a DataFrame.  ``focal=None`` computes
a metric for every reporter in one job; ``focal=<code>`` pushes that reporter
down to the scan.
"""

from portolan.sources.readers import TradeData, load

__all__ = ["TradeData", "load"]
