"""Refinement operators and what is computed from colourings."""
