"""Logical plans: grains, the order table, marts, KPIs, questions, views."""
