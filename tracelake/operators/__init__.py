"""Operators on plans, traces and runs."""
