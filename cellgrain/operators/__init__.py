"""Analytic operators: functions (DataFrame, options) -> lazy DataFrame."""
