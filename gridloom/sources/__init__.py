"""Sources and sinks: raster views, images, generators, shared tables."""
