"""Relations to relations: import, audit, collection, browse tree, events."""
