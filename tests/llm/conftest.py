import os

# the networks' numpy code is tested beside Spark's own threads
os.environ.setdefault("OMP_NUM_THREADS", "1")
