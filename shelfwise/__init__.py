"""shelfwise: storefront order, catalogue, customer and inventory analytics on Spark.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver; the few operators that need a
materialisation point (the keyed scan, order admission) use reliable
``checkpoint()`` into the session's ``spark.checkpoint.dir``.
"""

from shelfwise.session import get_session, require_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
