"""Explicit schemas of every file that is read or written."""

WORKS = (
    "id string, publication_year int, topics array<struct<field: struct<display_name: string>>>, "
    "authorships array<struct<author: struct<display_name: string>>>, referenced_works array<string>"
)
WORKS_PARQUET = "id string, publication_year int, primary_topic struct<field: struct<display_name: string>>"
MANIFEST = "files array<struct<url: string>>"
ATTRIBUTES = "id string, year string, field string, author string"
EDGES = "source string, targets string"
PAIRS = "paper_a string, paper_b string"
DIVERSITY = "id bigint, diversity_count int"
N_CITED = "id bigint, n_cited bigint"
N_MUTUAL = "id bigint, n_mutual bigint"
PRE_FIELDS = "id bigint, field string"
