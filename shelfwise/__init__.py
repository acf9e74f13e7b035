"""shelfwise: retail decision analytics as Spark DataFrame jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects;
nothing is collected to the driver inside the library (the only actions are
the explicit sinks in :mod:`shelfwise.sources.sinks`, lineage cuts via
``checkpoint()`` and the model fits in :mod:`shelfwise.operators.forecast` /
:mod:`shelfwise.operators.recommend`).
"""

__version__ = "0.1.0"
