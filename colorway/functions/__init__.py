"""Column-level rules: functions from Column to Column, used inside jobs."""
