"""Part of meridia: functions."""
