"""DataFrame -> DataFrame operators; fitted steps are fit/transform pairs."""
