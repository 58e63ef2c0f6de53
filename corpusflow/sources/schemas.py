"""Schemas of inputs and stored tables; nothing is inferred."""

QUESTION_SCHEMA = "id string, repo string, kind string, split string, question string, expect array<struct<path: string, symbol: string>>"
HIT = "struct<id: string, score: double, path: string, symbol: string, parent: string, names: array<string>, kind: string, part: int, is_test: boolean, is_changelog: boolean, passage_key: string, cost: int>"
RUN_SCHEMA = (
    "run_id string, repo string, model string, dim int, k int, max_tokens int, final boolean, "
    f"questions array<struct<id: string, kind: string, split: string, rank: int, found_in_context: boolean, hits: array<{HIT}>>>"
)
EVENT_SCHEMA = "type string, text string, message string"
CHUNKS = (
    "project_id bigint, id string, rel_path string, content_hash string, ordinal int, kind string, symbol string, parent string, names array<string>, "
    "part int, part_count int, start_line int, end_line int, text string, embed_text string, synthetic boolean, parse_error boolean, "
    "embed_model string, embed_dim int, embedding array<float>"
)
USAGE_CALLS = (
    "id bigint, at timestamp, provider string, model string, kind string, outcome string, prompt_tokens bigint, thinking_tokens bigint, answer_tokens bigint, estimated boolean"
)
