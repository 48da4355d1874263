"""reelcat: media-ingestion analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark's own expressions, so Catalyst plans it and the work
is partitioned and shuffled by Spark.  Sub-packages:

* ``sources``   -- table readers, fixture views, object/JSON sources and sinks
* ``functions`` -- Column-level helpers (URL identity, object keys, errors)
* ``operators`` -- catalogue, identity, media, lifecycle and metrics operators
* ``streaming`` -- Structured Streaming twins of the batch operators
* ``plans``     -- the registered queries and their SQL oracles
"""

from reelcat.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
