"""Training-data operators: deduplication, packing, sharding, filtering and scoring of documents.

Nothing else in the library imports this subpackage."""
