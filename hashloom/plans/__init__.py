"""Registered queries, their SQL twins and the merge planner."""
