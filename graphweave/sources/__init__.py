"""What a query reads and writes: bindings of types to DataFrames, schema texts, sinks."""
