"""Demand forecasters and their evaluation."""
