"""Transcript and speaker-diarization analytics on PySpark DataFrames."""
