"""Registered queries, one module for each operator."""
