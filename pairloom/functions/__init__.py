"""Column functions: everything here builds expressions that stay inside the JVM, unless it says otherwise."""
