"""Tables, contracts, registries and raw dumps as DataFrames."""
