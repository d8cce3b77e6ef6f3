"""Composed runs: infiltration fits, site merge and plot summary."""
