"""seqloom: small-RNA read analytics and corpus preparation on Spark DataFrames."""

import os

# Spark runs a task on each core; a linear-algebra library that starts threads of its own in each only gets in the way.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

__version__ = "0.1.0"
