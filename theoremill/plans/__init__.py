"""The query catalogue: each module has QUERIES (name -> function of session and table folder) and ORACLES
(the same in DuckDB's SQL, where SQL can express it)."""
