"""tidemark: coastal water-level and flood-exposure analytics as Spark jobs."""
