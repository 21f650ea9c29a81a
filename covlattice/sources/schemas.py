"""Schemas of manifests, samples and graph records; nothing is inferred."""

MANIFEST = (
    "schema_version STRING, dataset_name STRING, mode STRING, samples STRING, rtl_graphs STRING, asm_graphs STRING, "
    "total BIGINT, errors INT"
)
TARGETS = (
    "STRUCT<edge_coverage: STRUCT<encoding: MAP<STRING, STRING>, edge_count: INT, `default`: INT, "
    "labels: ARRAY<STRUCT<edge_id: INT, label: INT>>>, "
    "graph_coverage: STRUCT<unit: STRING, scope: STRING, `values`: MAP<STRING, DOUBLE>, mask: MAP<STRING, BOOLEAN>>, "
    "coverage_vectors: MAP<STRING, STRUCT<`schema`: STRING, element_count: INT, items: ARRAY<STRUCT<id: INT, label: INT>>>>>"
)
SAMPLE = (
    "schema_version STRING, sample_id STRING, test_id STRING, module_name STRING, asm_graph STRING, rtl_graph STRING, "
    f"rtl_graph_hash STRING, asm_graph_hash STRING, targets {TARGETS}"
)
RTL_GRAPH = (
    "schema_version STRING, module_name STRING, nodes ARRAY<STRUCT<id: STRING, type: STRING, cell_type: STRING, width: INT, "
    "input_ports: ARRAY<STRING>, output_ports: ARRAY<STRING>>>, edges ARRAY<STRUCT<edge_id: INT, source: STRING, "
    "target: STRING, source_port_idx: INT, target_port_idx: INT, type: STRING, width: INT>>"
)
ASM_GRAPH = (
    "entry_node STRING, exit_nodes ARRAY<STRING>, nodes MAP<STRING, STRUCT<id: STRING, node_type: STRING, "
    "instructions: ARRAY<STRUCT<mnemonic: STRING, operands: ARRAY<STRING>>>>>, "
    "edges ARRAY<STRUCT<source: STRING, target: STRING, edge_type: STRING>>"
)
DATASET_VERSION, SAMPLE_VERSION = "dataset.v1", "sample.v1"
