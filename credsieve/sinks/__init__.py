"""Sinks: baseline, JSON and SARIF reports."""
