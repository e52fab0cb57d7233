"""Process-tag analytics as DataFrame-to-DataFrame operators on Spark."""

from sensorium.series import Series

__all__ = ["Series"]
