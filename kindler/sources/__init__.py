"""Sources and sinks: tables, delimited and JSON files, vector, raster and grid files, HTTP chunks and request plans."""
