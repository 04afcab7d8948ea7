"""normlake: privacy normalisation and provenance auditing of text, URL and run tables on Spark."""
