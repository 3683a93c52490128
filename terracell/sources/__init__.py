"""Reading and writing: partitioned values with extents, tiles as text and images."""
