"""Where vectors come from."""

from nearfield.sources.npy import NpyDataSource, read_npy, write_npy  # noqa: F401
from nearfield.sources.random import random_bytes, random_vectors  # noqa: F401
