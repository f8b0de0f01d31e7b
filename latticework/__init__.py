"""Latticework: chart-graph analytics and trajectory statistics as DataFrame operators."""
