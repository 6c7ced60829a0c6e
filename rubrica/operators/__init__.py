"""Evaluation, roll-up and reporting operators over DataFrames."""
