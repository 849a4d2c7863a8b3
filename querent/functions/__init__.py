"""Part of querent: functions."""
