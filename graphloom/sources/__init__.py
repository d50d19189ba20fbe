"""Sources and sinks: text loaders, the graph store, the reply cache."""
