"""Sources of documents, predictions and annotations."""

from .files import digests, exists, first_rows, fresh_cache, listing, numbered_lines, read_cache, read_document, read_manifest, read_pairs, stale_keys, union_levels, with_files

__all__ = ["digests", "exists", "first_rows", "fresh_cache", "listing", "numbered_lines", "read_cache", "read_document", "read_manifest", "read_pairs", "stale_keys", "union_levels", "with_files"]
