"""Operators: geometry to selection, the join of cells and selection, statistics, summaries and other numerical policies."""
