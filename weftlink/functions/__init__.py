"""Part of the weftlink engine: functions."""
