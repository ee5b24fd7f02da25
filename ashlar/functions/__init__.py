"""Scalar and aggregate functions with the dialect's rules, as functions of columns.

They stay on the JVM side (no Python UDF), except where a module says so.
"""
