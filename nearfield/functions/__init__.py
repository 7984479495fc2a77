"""Column functions over vectors."""

from nearfield.functions.vectors import (  # noqa: F401
    argmax,
    axpy,
    distance_of,
    dot,
    l2_normalize,
    register_sql,
    squared_l2,
    subvector,
    vector_add,
)
