"""Relational operators over detections, events, devices and metrics."""
