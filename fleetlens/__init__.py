"""fleetlens: fleet inventory and operations analytics as Spark DataFrame operators.

Every operator takes DataFrames and column names and returns a DataFrame;
no operator collects data to the driver. See README.md for the catalogue.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions and classes that run on executors (the row-map helper, the
# state processors, user functions defined in this package) are shipped by
# value, so executors need pandas and PySpark but not this package
# installed. A cluster that installs the package works the same way.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older serializer without the hook: install the package on executors
    pass
