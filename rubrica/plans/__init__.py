"""Plan-time compilation of rubrics into Column expressions."""
