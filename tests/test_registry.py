import builtins
import dis
from types import CodeType

from ledgerlight.plans import registry


def _globals_read(code):
    for step in dis.get_instructions(code):
        if step.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
            yield step.argval
    for inner in code.co_consts:
        if isinstance(inner, CodeType):
            yield from _globals_read(inner)


def test_queries_read_only_names_that_exist():
    for name, query in registry.QUERIES.items():
        known = query.__globals__
        missing = {n for n in _globals_read(query.__code__) if n not in known and not hasattr(builtins, n)}
        assert not missing, (name, missing)
