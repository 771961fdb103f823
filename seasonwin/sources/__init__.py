"""Typed readers and writers."""

from seasonwin.sources.tables import *  # noqa: F401,F403
