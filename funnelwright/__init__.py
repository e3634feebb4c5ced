"""Product analytics as Spark jobs: panels, growth, experiments, profiling, checks."""
