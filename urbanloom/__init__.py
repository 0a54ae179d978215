"""Urban and geospatial analytics as functions from DataFrame to DataFrame."""
