"""boxquery: relational operators for object-detection data, on the DataFrame API."""
