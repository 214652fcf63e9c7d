"""Column expressions (all built-in Spark functions, no Python UDFs)."""
from .exprs import *  # noqa: F401,F403
