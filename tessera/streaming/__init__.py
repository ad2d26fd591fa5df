"""Deliberately empty: every operator of this library works on bounded matrices; there is no unbounded input to serve."""
