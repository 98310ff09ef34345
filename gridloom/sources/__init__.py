"""Reading and writing cubes, vector layers, statistics, vectors and exports."""
