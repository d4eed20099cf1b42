"""Carriers that turn plain tables into tag rows, the end-to-end plan, plug-ins, and the registered queries."""
