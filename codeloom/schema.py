"""Column contracts of the code model; operators take DataFrames that have these columns."""

FILES = "path string, content_hash string, indexed_at timestamp, content_changed_at timestamp, authored_at timestamp"
SYMBOLS = "fqn string, path string, kind string, name string, class_context string, start_line int, end_line int, text string"
LOCATIONS = "fqn string, path string, start_line int, end_line int, text string"
CHUNKS = "path string, scope string, tier int, start_line int, end_line int, text string, tags array<string>"
EDGES = "source_fqn string, target string, kind string, resolved_target string, candidate boolean, confidence double, receiver_type string, bound_module string, member_call boolean, external boolean"
REFS = "path string, symbol_name string, symbol_fqn string, line int, ref_kind string, context_fqn string"
TYPES = "fqn string, return_type string, params array<struct<name:string,type:string>>, type_params string, is_async boolean, is_generator boolean"
VECTORS = "vec_id bigint, tier string, embedding array<float>"
RANKING = "query_id string, item_id string, rank int, score double"
QRELS = "query_id string, item_id string, gain int"

#: The edge kinds that the model stores.
EDGE_KINDS = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "OWNS", "PROVIDES_CONTEXT", "CONSUMES_CONTEXT", "INSTANTIATES", "READS", "WRITES", "ALIAS_OF")
#: Tier names, sizes and overlaps in tokens.
TIERS = {1: ("tier1_surgical", 500, 50), 2: ("tier2_component", 1500, 100), 3: ("tier3_architectural", 4000, 200)}
