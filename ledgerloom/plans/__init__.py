"""Whole plans: one per statement layout, the parse of mixed statements, and the staged job."""
