"""The stages of the fiscal pipeline as column expressions."""
