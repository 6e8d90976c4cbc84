"""Calibrated novelty detection and retrospective validation on Spark DataFrames."""
