"""Schemas of the tables the operators read, in DDL."""

#: A scanned file. Code records have full_content and the arrays, others file_type.
FILES = (
    "file_id long, repository string, path string, extension string, lines int, content_preview string, full_content string, "
    "imports array<string>, functions array<string>, classes array<string>, file_type string, scanned_at timestamp_ntz, loaded_at timestamp_ntz"
)
COMMITS = ("commit string, repository string, date timestamp_ntz, message string, loaded_at timestamp_ntz")
COMMIT_FILES = ("commit string, repository string, path string, insertions int, deletions int")
HISTORY = ("entity string, repository string, commit string, date timestamp_ntz, lines int, complexity int")
EDGES = ("repository string, src string, dst string")
