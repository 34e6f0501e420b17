"""newsweft: situation monitoring over news and hazard feeds, as PySpark jobs."""
