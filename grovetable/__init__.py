"""grovetable: table profiling, cleaning, scoring, indicators and linkage as Spark DataFrame operators."""
