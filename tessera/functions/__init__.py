"""Functions of the engine, declared as registered queries."""
