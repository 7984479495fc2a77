"""Indexes: what is trained or stored, with the searches over it."""

from nearfield.plans.indexes import FlatIndexL2, IVFIndex  # noqa: F401
