"""Bindings of operators to tables: derived views and the registered queries."""
