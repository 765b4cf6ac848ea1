"""Tool registry (UDF-1, FLT-4): tool name -> Column-building function.

The service keeps a dict of callables and invokes one per row.  Here each
tool is a function that returns a *Column* (a result struct built from
columns already joined onto the row), so dispatch is a ``CASE`` on the tool
name evaluated inside codegen -- no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import accounts as A

ToolFn = Callable[[], Column]

REGISTRY: dict[str, ToolFn] = {
    C.TOOL_BALANCE: lambda: A.balance_result(),
    C.TOOL_TIER: lambda: A.tier_change_result("account_id"),
}


def known_tool(name: Column) -> Column:
    """FLT-4: membership in the registry (calls to other names are dropped)."""
    return name.isin(*REGISTRY.keys())


def dispatch_json(name: Column, asked: str = "target_tier") -> Column:
    """JSON text of the named tool's result struct (null for an unknown tool); ``asked``: the column of the tier asked for."""
    chain = None
    for tool, fn in REGISTRY.items():
        branch = F.to_json(fn())
        if tool == C.TOOL_TIER:
            branch = F.coalesce(branch, F.to_json(A.tier_failure_result(F.col(asked))))
        chain = F.when(name == tool, branch) if chain is None else chain.when(name == tool, branch)
    return chain
