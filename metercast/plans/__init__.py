from . import registry  # noqa: F401  (first: the query families refer to each other in its order)
