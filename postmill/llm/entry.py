"""Every query of this subpackage and its SQL."""

from . import audit_queries, native_queries, python_queries

QUERIES = {**native_queries.QUERIES, **python_queries.QUERIES, **audit_queries.QUERIES}
SQL = {**native_queries.SQL, **python_queries.SQL, **audit_queries.SQL}
