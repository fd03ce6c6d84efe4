"""Named queries with their reference SQL, and whole-book pipelines."""
