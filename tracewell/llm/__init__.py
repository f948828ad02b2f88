"""Operations of a large training-data pipeline, as Spark jobs. Nothing outside this package imports it."""
