"""Sources and sinks: inline rasters, tables as rasters, GeoTIFF files, snapshots."""
