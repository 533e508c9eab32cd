"""Workflow graphs: parsing, analysis and compilation to DataFrame plans."""
