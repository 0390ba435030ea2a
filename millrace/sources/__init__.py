"""Tables: catalog, snapshots on a file system, working storage."""
