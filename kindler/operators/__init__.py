"""DataFrame operators: ranking and statistics, spatial, raster, time series, scoring, validation, models, checks."""
