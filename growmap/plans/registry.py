"""Query names of the library, with their DuckDB twins."""

import inspect

from growmap.plans import queries, training, training_twins, twins

_HELPERS = ("table", "rows_of", "neurons_of", "holed", "scored", "r6")
QUERIES = {n: f for m in (queries, training) for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and n[0] != "_" and n not in _HELPERS}
SQL = twins.SQL | training_twins.SQL
