"""Whole plans: the fiscal pipeline, and the renderer of test invoices."""
