"""gridlake: solar and wind generation analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` over keyed time series
(``site_id``, ``ts``, ``row_id``).  Nothing is collected to the driver except
column-name metadata, row counts of small statistic tables (to decide whether
they may be broadcast) and fitted models.
"""

from gridlake.config import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
