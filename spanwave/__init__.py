"""Spark-native analytics over trigger-recorded, multi-sensor waveform data."""
