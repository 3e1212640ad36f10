"""A Spark-first engine for gridding, geostatistics and synthetic subsurface data."""

import os

# Tasks share an executor's cores, so each uses one thread for linear algebra. It has to be set before numpy is imported.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
