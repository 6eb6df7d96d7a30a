"""Schemas of the engine's tables."""

CHUNKS = (
    "ord bigint, id string, source string, kind string, path string, name string, start_line int, end_line int, location string, "
    "signature string, docstring string, parent string, context string, text string, content_hash string, llm_context string"
)
ERRORS = "path string, message string"
VECTORS = "provider string, content_hash string, vec array<float>"
QUESTIONS = "id string, question string, expect_files array<string>, expect_symbols array<string>, note string, split string"
PROJECTS = (
    "id string, name string, repo string, index string, provider string, model string, mode string, chunks int, files int, added string"
)
