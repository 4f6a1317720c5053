"""Sequential and per-source algorithms on a graph of checked size, held as compressed sparse rows."""
