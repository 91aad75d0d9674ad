"""newsloom — news and text analytics as Spark jobs.

Every operator is a function ``DataFrame (+ arguments) -> DataFrame`` built
from the DataFrame/SQL API, so Catalyst can prune, push down and plan it.
Python workers are used only where the built-in expressions cannot state the
rule (blocked dense-vector products, pluggable model scoring).
"""

__version__ = "0.1.0"
