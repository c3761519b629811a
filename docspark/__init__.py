"""Set-at-a-time operators for document ingest, catalogs and access logs, on PySpark."""
