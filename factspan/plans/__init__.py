"""Whole reports and drill-downs."""
