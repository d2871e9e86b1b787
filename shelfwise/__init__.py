"""Shelfwise: product-listing analytics as Spark DataFrame jobs over landed pages."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its few Python functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from shelfwise.runtime import release, session, staged, work_dir  # noqa: E402
from shelfwise.site import DEFAULT_SITE, SiteProfile  # noqa: E402

__all__ = ["DEFAULT_SITE", "SiteProfile", "release", "session", "staged", "work_dir"]
