"""Whole evaluations over many data sets or languages."""
