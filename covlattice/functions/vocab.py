"""Vocabularies of graph records and their encodings as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that graph records and models share, in their natural order.

#: Coverage types in the order of regression targets.
TARGET_ORDER = ["branch", "line", "fsm", "toggle", "condition"]
#: Coverage types in the order of set geometry.
GEOMETRY_ORDER = ["line", "condition", "toggle", "fsm", "branch"]

NODE_TYPES = [
    "INPUT", "OUTPUT", "CONSTANT", "COMBINATIONAL", "SEQUENTIAL", "MEMORY",
    "MUX", "ARITHMETIC", "LOGIC", "COMPARE", "SHIFT", "UNKNOWN",
]
EDGE_TYPES = ["DATA", "DATA_TRUE", "DATA_FALSE", "CONTROL", "CLOCK", "RESET", "ENABLE"]
ASM_NODE_TYPES = [
    "ENTRY", "EXIT", "BASIC_BLOCK", "BRANCH", "JUMP", "CALL", "LOGIC", "SHIFT", "COMPARE", "MAC",
    "SIMD", "LOAD", "STORE", "MEMORY", "CSR", "SYSTEM", "HWLOOP", "NOP", "UNKNOWN",
]
ASM_EDGE_TYPES = [
    "CONTROL_FLOW", "BRANCH_TAKEN", "BRANCH_NOT_TAKEN", "JUMP", "CALL",
    "RETURN", "DATA_DEP", "MEMORY_DEP", "ANTI_DEP", "OUTPUT_DEP",
]

#: Cell types by the coarse node type they belong to; a cell's code is its place in this listing.
CELLS_BY_NODE_TYPE = [
    ("INPUT", ["INPUT"]),
    ("OUTPUT", ["OUTPUT"]),
    ("CONSTANT", ["CONSTANT"]),
    ("MUX", ["$mux", "$pmux", "$bmux", "$demux"]),
    ("COMBINATIONAL", ["$tribuf"]),
    ("SEQUENTIAL", [
        "$dff", "$dffe", "$adff", "$adffe", "$asdff", "$asdffe", "$sdff", "$sdffe", "$sdffce", "$dlatch", "$adlatch",
        "$dlatchsr", "$sr", "$ff", "$aldff", "$aldffe",
    ]),
    ("MEMORY", ["$mem", "$mem_v2", "$memrd", "$memrd_v2", "$memwr", "$memwr_v2", "$meminit", "$meminit_v2"]),
    ("ARITHMETIC", ["$add", "$sub", "$mul", "$div", "$mod", "$divfloor", "$modfloor", "$pow", "$neg", "$pos"]),
    ("COMPARE", ["$eq", "$ne", "$lt", "$le", "$gt", "$ge", "$eqx", "$nex"]),
    ("LOGIC", [
        "$and", "$or", "$xor", "$xnor", "$not", "$reduce_and", "$reduce_or", "$reduce_xor", "$reduce_xnor", "$reduce_bool",
        "$logic_and", "$logic_or", "$logic_not",
    ]),
    ("SHIFT", ["$shl", "$shr", "$sshl", "$sshr", "$shift", "$shiftx"]),
    ("COMBINATIONAL", ["$concat", "$slice", "$lut", "$sop"]),
    ("UNKNOWN", ["UNKNOWN"]),
]

#: Aggregation group of each node type, in the order of the node types.
AGG_GROUPS = [0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]

CELL_TYPES = [cell for _, cells in CELLS_BY_NODE_TYPE for cell in cells]
_NODE_OF_CELL = [NODE_TYPES.index(kind) for kind, cells in CELLS_BY_NODE_TYPE for _ in cells]


def _lookup(keys: list, values: list, column: Column, default: int) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in zip(keys, values)))
    return F.coalesce(F.element_at(pairs, column), F.lit(default))


def cell_code(cell: Column) -> Column:
    """Code of a cell type; unknown and null types have the last code."""
    return _lookup(CELL_TYPES, list(range(len(CELL_TYPES))), normalize_cell(cell), len(CELL_TYPES) - 1)


def normalize_cell(cell: Column) -> Column:
    """Port cells are written in capitals; nothing else changes."""
    return F.when(cell.isin("input", "output"), F.upper(cell)).otherwise(cell)


def node_code(cell: Column) -> Column:
    """Coarse node type of a cell type."""
    return _lookup(CELL_TYPES, _NODE_OF_CELL, normalize_cell(cell), NODE_TYPES.index("UNKNOWN"))


def edge_code(kind: Column) -> Column:
    """Code of an edge type; unknown types count as the first."""
    return _lookup(EDGE_TYPES, list(range(len(EDGE_TYPES))), kind, 0)


def asm_node_code(kind: Column) -> Column:
    return _lookup(ASM_NODE_TYPES, list(range(len(ASM_NODE_TYPES))), kind, ASM_NODE_TYPES.index("UNKNOWN"))


def asm_edge_code(kind: Column) -> Column:
    return _lookup(ASM_EDGE_TYPES, list(range(len(ASM_EDGE_TYPES))), kind, 0)


def agg_group(node_type: Column) -> Column:
    return F.get(F.array(*[F.lit(g) for g in AGG_GROUPS]), node_type)


def coverage_index(ctype: Column, order: list[str] = TARGET_ORDER) -> Column:
    """Place of a coverage type in an order; an unknown type is an error."""
    known = F.array(*[F.lit(c) for c in order])
    return F.when(ctype.isin(order), F.array_position(known, ctype) - 1).otherwise(
        F.raise_error(F.concat(F.lit("unknown coverage type: "), F.coalesce(ctype, F.lit("null")))).cast("long")
    )
