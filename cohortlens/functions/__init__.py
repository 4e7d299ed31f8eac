"""Column builders: site codes, text, calendar and arithmetic. All stay inside the JVM."""
