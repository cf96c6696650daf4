"""The ten tables of a dataset version."""

from __future__ import annotations

SCHEMA_VERSION = 10

TABLES = {
    "index_info": "schema_version int, built_at timestamp, fts_indexed boolean, single_repository boolean",
    "repositories": "repo_id long, slug string, url string, head_commit string, file_count long, line_count long, byte_count long",
    "files": "file_id long, repo_id long, repo_slug string, path string, qualified_path string, directory string, name string, extension string, size_bytes long, line_count long, skip_reason string, first_commit long, last_commit long, module string",
    "lines": "line_id long, file_id long, line_number int, content string, commit_id long",
    "commits": "commit_id long, repo_slug string, sha string, author_name string, author_email string, authored_at timestamp, subject string, body string",
    "commit_files": "commit_id long, repo_slug string, path string, change_kind string, added long, deleted long, old_path string",
    "attribution": "repo_slug string, path string, start_line int, end_line int, commit_id long",
    "path_lineage": "repo_slug string, path string, hop int, previous_path string, previous_commits long, combined_commits long",
    "imports": "import_id long, file_id long, line_number int, name string, shape string, target_file long, unresolved string, evidence string",
    "project_overview": "document string",
}
