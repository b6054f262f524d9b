"""codeloom: repository analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame.  Nothing is
collected to the driver; batches of questions, hashes or names are tables.
"""

from codeloom.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
