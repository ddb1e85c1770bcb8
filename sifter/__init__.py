"""sifter: experiment screening and planning as Spark DataFrame operators.

Rows are experiments; some columns are features (inputs), some targets
(responses).  Every operator takes and returns Spark DataFrames.  Work that
touches experiment rows runs as Spark aggregations, windows, joins, MLlib or
Arrow-batched ``mapInPandas``; only p x p matrices (p = number of features)
are finished on the driver.
"""

from sifter import _blas  # noqa: F401  (single-threaded BLAS per process)

__version__ = "0.1.0"
