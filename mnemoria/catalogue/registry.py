from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Queries over a few literal rows and their SQL, for tests; their names in QUERIES cover whole tables.
LITERAL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def whole(f, cut: str, all_rows, into: str = ""):
    """Registers ``f``'s name for all rows, its third argument; its SQL loses the limit ``cut``."""
    name = f.__name__

    def run(spark, sf):
        return f(spark, sf, all_rows)

    assert cut in ORACLES[name]
    QUERIES[name], ORACLES[name] = run, ORACLES[name].replace(cut, into)


def literal(f, run) -> None:
    """``f`` with its SQL is a test on literal rows; its name is registered for ``run``, over a whole table."""
    LITERAL[f.__name__] = f, ORACLES.pop(f.__name__)
    QUERIES[f.__name__] = run
