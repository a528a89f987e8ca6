"""deltaloom: change streams to denormalized documents, as Spark plans."""
