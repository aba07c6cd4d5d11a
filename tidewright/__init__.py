"""Learning linear models of nonlinear dynamics from series and trajectories, on Spark."""

import os

# Threads of a BLAS that was loaded before the JVM's launch forked can hang the driver's
# small solves; each task and the driver use one. No effect where NumPy is loaded already.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
