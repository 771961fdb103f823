"""Column expressions; everything here stays inside Catalyst."""

from seasonwin.functions.columns import *  # noqa: F401,F403
