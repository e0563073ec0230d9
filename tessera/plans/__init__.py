"""Named queries over the driver tables; importing this package registers them."""

from tessera.plans import customer_value, models, nulls, profiling, scalars, stats, verbs, windows  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES, Tables, register  # noqa: F401
