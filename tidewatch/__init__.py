"""tidewatch: change detection and sensor analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` (usable via
``df.transform``); nothing holds a global session.
"""

from tidewatch.session import build_session, checkpoint_dir, cluster_settings

__all__ = ["build_session", "checkpoint_dir", "cluster_settings"]
