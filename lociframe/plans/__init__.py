"""Registered queries: bindings of operators to the test tables, with the SQL that checks them."""
