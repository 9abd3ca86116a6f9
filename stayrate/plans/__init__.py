"""Compositions of operators: frames, model runs, and the query catalogue."""
