"""Tandem mass-spectrometry analytics and corpus preparation as Spark jobs."""
