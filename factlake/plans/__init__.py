"""Execution helpers shared by the operators: scratch tables, fixpoint loops, skew handling."""
