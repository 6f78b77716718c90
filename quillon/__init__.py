"""quillon: a strictly typed SQL engine and data-processing library on PySpark."""
