"""Training-data operators (ten) and the queries that apply them.

Nothing outside this subpackage imports it; deleting it leaves the document
revision engine whole.  ``queries.py`` holds the registered queries and SQL.
"""
