"""Column functions: text, money, dates and references. All stay inside the JVM."""
