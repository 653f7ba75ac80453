"""Budgets. Passing one is an error; results are never cut to fit."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from ..errors import ResourceLimit

CAP = 2**64 - 1


@dataclass(frozen=True)
class QueryLimits:
    max_input_rows: int
    max_input_bytes: int
    max_join_rows: int
    max_output_cells: int
    execution_memory_bytes: int

    def check_nonzero(self) -> None:
        if min(astuple(self)) <= 0:
            raise ResourceLimit("a budget of zero")


#: Budgets that admit any table; for callers that bound their inputs elsewhere.
UNBOUNDED = QueryLimits(CAP, CAP, CAP, CAP, CAP)


def join_bound(edge_rows: list[int], projections: int, limits: QueryLimits) -> int:
    """The product of edge-table sizes in path order, checked at every prefix before anything runs."""
    bound = 1
    for rows in edge_rows:
        bound *= rows
        if bound > min(limits.max_join_rows, CAP):
            raise ResourceLimit("join rows")
    if bound * projections > min(limits.max_output_cells, CAP):
        raise ResourceLimit("output cells")
    return bound
